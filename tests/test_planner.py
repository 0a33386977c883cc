"""Crawls in rounds against one planner a crawl that goes on step by step."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import whatwg
from weftline.operators import crawl, planner


class Alone:
    """One crawl, a route after another."""

    def __init__(self, seed, policy):
        self.policy, self.seed = policy, whatwg.parsed(seed)
        self.records, self.owner, self.bytes, self.elapsed, self.pages, self.states = [], {}, 0, 0, 1, 0
        self.records.append({"url": self.seed, "kind": "document", "state": "accepted", "reason": "seed-route", "alias": None})
        self.owner["document", self.seed.partition("#")[0]] = 0

    def over(self):
        return "time-budget" if self.elapsed >= self.policy.max_duration_ms else "byte-budget" if self.bytes >= self.policy.max_bytes else None

    def found(self, url, base, target):
        if len(self.records) >= self.policy.max_candidates:
            if all(r["reason"] != "candidate-budget" for r in self.records):
                self.records.append({"url": None, "kind": None, "state": "skipped", "reason": "candidate-budget", "alias": None})
            return
        record = {"url": None, "kind": None, "state": "skipped", "reason": None, "alias": None}
        self.records.append(record)
        if target not in (None, "", "_self"):
            record["reason"] = "non-self-target"
            return
        if not url.strip():
            record["reason"] = "empty-url"
            return
        full = record["url"] = whatwg.parsed(url, base)
        if not full.startswith("http"):
            record["reason"] = "non-http"
            return
        if full.split("/")[2] != self.seed.split("/")[2]:
            record["reason"] = "cross-origin"
            return
        bare = full.partition("#")[0]
        kind = record["kind"] = "history" if "#" in full and bare == base.partition("#")[0] else "document"
        key = (kind, full if kind == "history" else bare)
        if key in self.owner:
            record["reason"], record["alias"] = "duplicate-route", self.owner[key]
        elif self.over():
            record["reason"] = self.over()
        elif self.pages >= self.policy.max_pages:
            record["reason"] = "page-budget"
        elif kind == "history" and self.states >= self.policy.max_history_states:
            record["reason"] = "state-budget"
        else:
            record["state"], record["reason"] = "accepted", "same-origin-anchor"
            self.owner[key] = len(self.records) - 1
            self.pages += 1
            self.states += kind == "history"

    def run(self, visit):
        """visit(n, url) gives (final, canonical, bytes, elapsed, failed, [(url, base, target)])."""
        while True:
            queue = [n for n, r in enumerate(self.records) if r["state"] == "accepted"]
            if not queue:
                return
            if self.over():
                for n in queue:
                    self.records[n].update(state="skipped", reason=self.over())
                return
            n = queue[0]
            r = self.records[n]
            final, canonical, size, elapsed, failed, links = visit(n, r["url"])
            self.elapsed = max(self.elapsed, elapsed)
            if failed:
                r.update(state="failed", reason=failed)
            else:
                self.bytes += size
                r.update(state="captured", reason="rendered-captured")
                for url in [u for u in (r["url"], final, canonical) if u]:
                    key = (r["kind"], url if r["kind"] == "history" else url.partition("#")[0])
                    other = self.owner.get(key, n)
                    if other != n:
                        self.records[other].update(state="skipped", reason="canonical-alias" if url == canonical else "redirect-alias", alias=n)
                    self.owner[key] = n
            for link in links:
                self.found(*link)


def test_crawls_in_rounds(spark):
    """Random sites; some pages redirect, fail or take long, and every budget ends some crawl."""
    random.seed(4)
    sites, pages = 40, 12
    policy = crawl.Policy(max_pages=7, max_candidates=25, max_history_states=1, max_bytes=4000, max_duration_ms=9000)
    page = lambda c, k: f"https://s{c}.test/r{k}"
    links, visits = {}, {}
    for c in range(sites):
        for k in range(pages):
            base = page(c, k)
            links[c, k] = [(random.choice([f"/r{random.randrange(pages)}", f"r{random.randrange(pages)}#x", f"#s{random.randrange(3)}", "", "mailto:a@b", "https://other.test/", "/a/../r1", page(c, 2)]), base, random.choice([None, None, None, "_self", "_blank"])) for _ in range(random.randrange(9))]
            visits[c, k] = (page(c, k + 1) if random.random() < 0.2 and k + 1 < pages else None, page(c, random.randrange(pages)) + "#top" if random.random() < 0.15 else None, random.choice([10, 500, 1500]), "navigation-failed" if random.random() < 0.1 else None)
    number = lambda url: int(url.partition("#")[0].rpartition("/r")[2])
    want = []
    for c in range(sites):
        alone = Alone(page(c, 0), policy)
        alone.run(lambda n, url, c=c: (*visits[c, number(url)][:3], 900 * n, visits[c, number(url)][3], links[c, number(url)]))
        want += [(c, n, r["url"] if r["reason"] != "candidate-budget" else None, r["state"], r["reason"], r["alias"]) for n, r in enumerate(alone.records)]
    told = spark.createDataFrame([(c, k, *v) for (c, k), v in visits.items()], "crawl long, k long, final_url string, canonical_url string, bytes long, failed string")
    shown = spark.createDataFrame([(c, k, i, *link) for (c, k), own in links.items() for i, link in enumerate(own)], "crawl long, k long, position long, url string, base_url string, target string")

    def visit(routes):
        seen = routes.withColumn("k", F.regexp_extract("route_url", "/r([0-9]+)", 1).cast("long"))
        results = seen.join(told, ["crawl", "k"]).withColumn("elapsed_ms", (F.col("n") * 900).cast("long"))
        found = seen.join(shown, ["crawl", "k"])
        for name, kind in (("element_kind", "string"), ("transition_kind", "string"), ("download", "boolean"), ("form_action", "boolean")):
            found = found.withColumn(name, F.lit(None).cast(kind))
        return results.select("crawl", "n", "final_url", "canonical_url", "bytes", "elapsed_ms", "failed"), found.drop("transition_kind").withColumn("transition_kind", F.lit(None).cast("string")).drop("n", "k", "route_url")

    seeds = spark.createDataFrame([(c, page(c, 0)) for c in range(sites)], "crawl long, seed_url string")
    got = planner.planned(seeds, visit, policy).collect()
    unread = ("candidate-budget", "non-self-target", "empty-url")  # refused before their URL is looked at
    rows = [(r["crawl"], r["n"], None if r["reason"] in unread else r["route_url"], r["state"], r["reason"], r["alias_of"]) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    reasons = {r["reason"] for r in got}
    assert {"candidate-budget", "page-budget", "state-budget", "time-budget", "byte-budget", "redirect-alias", "canonical-alias", "duplicate-route", "navigation-failed"} <= reasons


def test_no_crawls(spark):
    seeds = spark.createDataFrame([(1, None)], "crawl long, seed_url string")
    assert planner.planned(seeds, lambda routes: (routes, routes)).count() == 0


def test_a_round_takes_many_crawls_at_once():
    """Crawls come in batches of rows, not a group of its own each; one without candidates goes on too."""
    stored = T.StructType([T.StructField("crawl", T.LongType()), *planner._STATE_FIELDS])
    first = dict.fromkeys(planner._COLUMNS) | {"n": 0, "route_url": "https://h.test/", "transition_kind": "document", "state": "visiting", "keys": ["document:https://h.test/"], "bytes": 0, "elapsed_ms": 0, "turn": 0, "taken": True}
    record = first | {"final_": None, "canonical_": None, "bytes_": 10, "elapsed_": 5, "failed": None}
    offered = {"position": 1, "route_url": "https://h.test/a", "transition_kind": "document", "key": "document:https://h.test/a", "fixed": None}
    batch = pa.RecordBatch.from_pylist([{"crawl": 1, "records": [record], "found": [offered]}, {"crawl": 2, "records": [record], "found": None}])
    (done,) = planner._rounds(crawl.Policy(), 1, stored)(iter([batch]))
    assert [(r["crawl"], r["n"], r["state"], r["bytes"]) for r in done.to_pylist()] == [(1, 0, "captured", 10), (1, 1, "visiting", 0), (2, 0, "captured", 10)]
