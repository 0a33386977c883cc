"""Names in archives against a walk, integrity rules one by one, and joins and sums over groups of any size."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from weftline.functions import paths
from weftline.operators import graph, names, ranks
from weftline.plans import integrity
from weftline.sources.tables import materialized


def walked(bases):
    """The first free name of each, in order."""
    used, out = set(), []
    for base in bases:
        front, dot, ending = base.rpartition(".")
        name, n = base, 2
        while name in used:
            name, n = f"{front}-{n}{dot}{ending}" if front else f"{base}-{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def named(spark, bases, parts=5):
    rows = spark.createDataFrame([(b, i, f"u{i}") for i, b in enumerate(bases)], "base_path string, position long, url string").repartition(parts)
    got = {r["position"]: r["local_path"] for r in names.named(rows).collect()}
    return [got[i] for i in range(len(bases))]


CASES = [
    ["a.html"] * 5,
    ["a-2.html", "a.html", "a.html", "a-2.html", "a-2-2.html", "a.html", "a-2.html"],
    ["a.html", "a.html", "a-2.html", "a-2.html", "a-3.html", "a.html", "a-2-2.html", "a-2-2-2.html", "a-2-2.html"],
    [".htaccess", ".htaccess", ".htaccess-2", "x", "x-2", "x", "x", "x.y/z-2", "x.y/z", "x.y/z", "x-2.y/z"],
    ["a-02.html", "a.html", "a.html", "a-1.html", "a-1.html", "a-0.html", "-2.html", "-2.html", "a-.html", "a--2.html", "a-.html", "a-.html"],
    [f"item-{i}.html" for i in range(40)] + ["item.html", "item.html", "item-3.html"],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_names_as_walked(spark, case):
    assert named(spark, CASES[case]) == walked(CASES[case])


def test_names_of_random_paths(spark):
    random.seed(5)
    for size, numbers, depth in ((60, 3, 3), (250, 6, 2), (250, 40, 1), (300, 2, 4)):
        bases = [random.choice("ab") + "".join(f"-{random.randint(0, numbers)}" for _ in range(random.randint(0, depth))) + random.choice([".html", ".html", "", ".js"]) for _ in range(size)]
        assert named(spark, bases) == walked(bases), bases


def test_no_family_is_one_task(spark):
    """A hundred thousand numbered pages of one host, whose stem is taken three times at last: no range of rows is far above the others."""
    n = 100_000
    rows = spark.range(n).selectExpr("concat('item-', id, '.html') AS base_path", "id AS position", "concat('u', id) AS url").union(spark.range(3).selectExpr("'item.html'", f"id + {n}", "concat('v', id)"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = ranks.spread(rows, ["base_path"], ["position", "url"])
        sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
        assert len(sizes) == 4
        assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
        got = names.named(rows)
        assert {r["local_path"] for r in got.where(f"position >= {n}").collect()} == {"item.html", f"item-{n}.html", f"item-{n + 1}.html"}
        assert got.where(f"position < {n} and local_path <> base_path").count() == 0
        hot = ranks.spread(spark.range(20_000).selectExpr("'one.html' AS base_path", "id AS position"), ["base_path"], ["position"])
        assert hot.select("part").distinct().count() == 4
        ranked = ranks.running(hot, ["base_path"], ["position"], paths.F.lit(1), "n")
        assert ranked.where("n <> position + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_join_with_frequent_keys(spark):
    left = materialized(spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 7 END AS k", "id AS v"))
    right = materialized(left.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 1").selectExpr("k", "n", "concat('x', k) AS told"))
    got = Counter((r["k"], r["v"], r["told"]) for r in ranks.joined(left, right, ["k"], "n").collect())
    assert got == Counter((k, v, f"x{k}") for k, v in ((i if i % 3 == 0 else 7, i) for i in range(5000)) if k % 2)


# integrity --------------------------------------------------------------------------------------------------------


def test_every_rule_is_broken_somewhere(spark, sf):
    rules = {(r["rule"], r["family"]) for r in integrity.graph_integrity(spark, sf.replace("sf0.001", "sf0.01")).select("rule", "family").distinct().collect()}
    there = {f: {c for c, _ in columns} for f, (_, columns) in integrity._FAMILIES.items()}
    wanted = {(f"dangling-{c.replace('_', '-').replace('.', '-')}", f) for f, c, _ in graph.REFERENCES}
    wanted |= {("dangling-evidence-refs", f) for f, columns in there.items() if "evidence_refs" in columns} | {("dangling-mission-id", f) for f in there if f != "missions"}
    wanted |= {("request-body-hash-form", "requests"), ("content-hash-form", "responses"), ("content-hash-form", "bodies"), ("negative-size", "bodies"), ("body-without-bytes", "bodies"), ("acquisition-provenance", "bodies")}
    wanted |= {("snapshot-version", "documents"), ("body-state", "responses"), ("transition-kind", "routes"), ("route-state", "routes"), ("skipped-without-reason", "routes"), ("missing-id", "targets"), ("missing-id", "api_exchanges")}
    assert wanted <= rules
    assert all(outer.partition(".")[0] in there[f] for f, outer, _ in graph.REFERENCES)  # no reference is left without rows


def test_each_family_is_read_once(spark, sf):
    """What is held against each other is one stored table, read a few times."""
    plan = integrity.graph_integrity(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "pages" not in plan
    assert plan.count("Relation") <= 8


def test_ids_and_references_are_aggregated_once(spark, sf):
    """What the report reads of them is stored: no aggregation of all ids is left to be made again with it."""
    plan = integrity.graph_integrity(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_graphs_are_apart(spark):
    """The same ids in two graphs are no repeats, and a record of another graph is no answer."""
    requests = spark.createDataFrame([("g1", "r1", "observed", "t1"), ("g2", "r1", "observed", "t1"), ("g2", "r2", "observed", None), ("g2", "r2", "observed", "")], "graph string, id string, provenance string, target_id string")
    targets = spark.createDataFrame([("g1", "t1", "observed")], "graph string, id string, provenance string")
    got = sorted(tuple(r) for r in graph.violations({"requests": requests, "targets": targets}, ("observed",), graph_col="graph").select("graph", "rule", "family", "id", "detail").collect())
    assert got == [("g2", "dangling-target-id", "requests", "r1", "t1"), ("g2", "duplicate-id", "requests", "r2", "2")]
    assert graph.violations({"requests": requests.limit(0), "targets": targets.limit(0)}, ("observed",)).count() == 0


def test_a_reference_that_most_records_share(spark):
    rows = [(f"r{i}", "observed", "m-lost" if i % 3 else "m1", ["r0", "gone"] if i % 3 else None) for i in range(3000)]
    requests = spark.createDataFrame(rows, "id string, provenance string, mission_id string, evidence_refs array<string>")
    missions = spark.createDataFrame([("m1", "observed")], "id string, provenance string")
    got = Counter((r["rule"], r["detail"]) for r in graph.violations({"requests": requests, "missions": missions}, ("observed",)).collect())
    assert got == {("dangling-mission-id", "m-lost"): 2000, ("dangling-evidence-refs", "gone"): 2000}


def test_headers_of_graphs(spark):
    rows = [("a", "ours", 1, 1), ("b", "theirs", 9, 9), ("c", "ours", 2, 2), ("d", None, None, None), ("e", "ours", None, None)]
    got = sorted((r["graph"], r["rule"], r["detail"]) for r in graph.header_violations(spark.createDataFrame(rows, "graph string, schema_name string, schema_version int, minimum_reader_version int"), "ours").collect())
    assert [(g, rule) for g, rule, _ in got] == [("b", "schema-name"), ("c", "minimum-reader-version"), ("c", "schema-version"), ("d", "schema-name"), ("e", "minimum-reader-version"), ("e", "schema-version")]
