"""What links reach, over several hops a round, against a walk by breadth."""

from __future__ import annotations

from weftline import plans
from weftline.operators import crawl

from .oracle import difference


def _walk(edges, start):
    depth, newest = {start: 0}, [start]
    while newest:
        newest = list({t for s, t in edges if s in newest} - set(depth))
        depth |= {t: max(depth.values()) + 1 for t in newest}
    return depth


def test_least_depths(spark):
    edges = [(str(n), str(t)) for n in range(23) for t in ((n + 1) % 23, n * n % 23, n)] + [("x", "0"), ("22", "y")]
    links, seeds = spark.createDataFrame([*edges, ("0", None)], "source string, target string"), spark.createDataFrame([("2",), ("2",)], "url string")
    whole = _walk(edges, "2")
    assert {r["url"]: r["depth"] for r in crawl.reachable(seeds, links, hops=3).collect()} == whole
    assert {r["url"]: r["depth"] for r in crawl.reachable(seeds, links, most_depth=4, hops=3).collect()} == {u: d for u, d in whole.items() if d <= 4}


def test_deep_tables_as_the_sql(spark, tmp_path):
    """Of 2500 pages the links reach 499 deep; the SQL goes 24 deep."""
    import duckdb

    spark.range(2500).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert not difference(plans.queries()["crawl_reachable"](spark, str(tmp_path)), db, plans.oracle_sql()["crawl_reachable"])
