"""Bounded crawls: the decision on each candidate, and what links reach."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import materialized


@dataclass(frozen=True)
class Policy:
    max_pages: int = 40
    max_candidates: int = 200
    max_history_states: int = 40
    max_bytes: int = 300 * 1024 * 1024
    max_duration_ms: int = 120_000


def shaped(candidates: DataFrame, seed_url: Column) -> DataFrame:
    """Candidates (base_url, url, element_kind, target, download, form_action, transition_kind) with route_url, transition_kind, key, and fixed: why one is refused whatever came before."""
    raw = F.coalesce("url", F.lit(""))
    base = F.coalesce(F.col("base_url"), seed_url)
    c = candidates.withColumn("seed_", urls.resolved(seed_url, seed_url)).withColumn("route_url", urls.resolved(raw, base)).withColumn("base_", urls.resolved(base, F.col("seed_")))
    history = (urls.fragment(F.col("route_url")) != "") & (urls.normalized(F.col("route_url")) == urls.normalized(F.col("base_")))
    c = c.withColumn("transition_kind", F.coalesce("transition_kind", F.when(history, "history").otherwise("document")))
    fixed = (
        F.when(F.coalesce("element_kind", F.lit("anchor")) != "anchor", "not-ordinary-anchor")
        .when(F.coalesce("download", F.lit(False)), "download-link")
        .when(F.coalesce("form_action", F.lit(False)), "form-navigation")
        .when(~F.lower(F.coalesce("target", F.lit(""))).isin("", "_self"), "non-self-target")
        .when(F.trim(raw) == "", "empty-url")
        .when(F.col("route_url").isNull(), "invalid-url")
        .when(~F.rlike(F.lower("route_url"), F.lit("^https?:")), "non-http")
        .when(urls.origin(F.col("route_url")) != urls.origin(F.col("seed_")), "cross-origin")
    )
    return c.withColumn("key", urls.route_key(F.col("route_url"), F.col("transition_kind"))).withColumn("fixed", fixed).drop("seed_", "base_")


def decide(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(crawl, position, route_url, transition_kind, state, reason) for candidates of each crawl in the order of position.

    candidates: crawl, seed_url, base_url, position, url, element_kind, target, download, form_action[, transition_kind, captured_bytes, elapsed_ms]. Past the candidate
    budget only the first is recorded, as candidate-budget. A key counts as taken only once a candidate of it was accepted; one that a budget
    refused is judged anew. Captured bytes and elapsed time are those so far, so they never fall within a crawl.
    """
    c = candidates
    for name, kind in (("transition_kind", "string"), ("captured_bytes", "long"), ("elapsed_ms", "long")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    order = Window.partitionBy("crawl").orderBy("position")
    c = c.withColumn("n", F.row_number().over(order)).where(F.col("n") <= policy.max_candidates + 1)
    c = shaped(c, F.col("seed_url"))
    c = c.withColumn("fixed", F.when(F.col("n") > policy.max_candidates, "candidate-budget").otherwise(F.col("fixed")))
    ended = F.when(F.coalesce("elapsed_ms", F.lit(0)) >= policy.max_duration_ms, "time-budget").when(F.coalesce("captured_bytes", F.lit(0)) >= policy.max_bytes, "byte-budget")
    c = c.withColumn("ended", ended)
    # what is refused anyway stays beside the rest, in groups of its own: each link is parsed once
    open_ = c.withColumn("open", F.col("fixed").isNull())
    order, alike = Window.partitionBy("crawl", "open").orderBy("position"), Window.partitionBy("crawl", "open", "key").orderBy("position")
    # budgets only run out, so a key's first candidate before they do is the one accepted
    open_ = open_.withColumn("first", (F.row_number().over(alike) == 1) & F.col("ended").isNull())
    states = F.sum((F.col("first") & (F.col("transition_kind") == "history")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = open_.withColumn("eligible", F.col("first") & ((F.col("transition_kind") != "history") | (states <= policy.max_history_states)))
    pages = F.sum(F.col("eligible").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = open_.withColumn("accepted", F.col("eligible") & (pages <= policy.max_pages))
    taken = F.max("accepted").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.col("accepted").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reason = F.when(F.col("accepted"), "same-origin-anchor").when(F.coalesce(taken, F.lit(False)), "duplicate-route").when(F.col("ended").isNotNull(), F.col("ended")).when(before >= policy.max_pages, "page-budget").otherwise("state-budget")
    judged = open_.withColumn("reason", F.coalesce("fixed", reason))
    return judged.select("crawl", "position", "route_url", "transition_kind", F.when(F.col("reason") == "same-origin-anchor", "accepted").otherwise("skipped").alias("state"), "reason")


def completed(accepted: DataFrame, results: DataFrame) -> DataFrame:
    """(crawl, position, state, reason, alias_of) of accepted routes (crawl, position, route_url, transition_kind) after their visits.

    results: (crawl, position, final_url, canonical_url), absolute. Routes are visited in the order of position. A visited route answers for its own, its final and
    its canonical URL: another accepted route of such a key is skipped, before its visit or after it. A crawl accepts no more routes than
    its policy has pages, so its walk is short.
    """
    rows = accepted.select("crawl", "position", "route_url", "transition_kind").join(results.select("crawl", "position", "final_url", "canonical_url"), ["crawl", "position"], "left")
    kind = rows.schema

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        routes = list(group.sort_values("position").itertuples(index=False))
        key = lambda url, kind: (kind, url if kind == "history" else url.partition("#")[0])
        owner = {key(r.route_url, r.transition_kind): n for n, r in enumerate(routes)}
        state = {n: ("accepted", "same-origin-anchor", None) for n in range(len(routes))}
        for n, r in enumerate(routes):
            if state[n][0] == "skipped":
                continue
            state[n] = ("captured", "rendered-captured", None)
            for url in dict.fromkeys(u for u in (r.route_url, r.final_url, r.canonical_url) if isinstance(u, str) and u):
                other = owner.get(key(url, r.transition_kind), n)
                if other != n:
                    state[other] = ("skipped", "canonical-alias" if url == r.canonical_url else "redirect-alias", r.position)
                owner[key(url, r.transition_kind)] = n
        return pd.DataFrame([(r.crawl, r.position, *state[n]) for n, r in enumerate(routes)], columns=["crawl", "position", "state", "reason", "alias_of"])

    types = {f: kind[f].dataType.simpleString() for f in ("crawl", "position")}
    return rows.groupBy("crawl").applyInPandas(walk, f"crawl {types['crawl']}, position {types['position']}, state string, reason string, alias_of {types['position']}")


MAX_RESOURCES, MAX_PAGES = 400, 40


def frontier(found: DataFrame, held: DataFrame, max_resources: int = MAX_RESOURCES, max_pages: int = MAX_PAGES) -> DataFrame:
    """(capture, url, kind, position, queued) of URLs that were found (capture, url, kind page or resource, position) and aren't held (capture, url).

    Each URL once, where it stands first. Pages beyond max_pages of a capture aren't queued, nor is anything once max_resources are; queued tells.
    """
    normal = found.withColumn("url", urls.normalized(F.col("url")))
    first = normal.groupBy("capture", "url").agg(F.min_by(F.struct("kind", "position"), "position").alias("first")).select("capture", "url", "first.*")
    new = materialized(first.join(held.select("capture", urls.normalized(F.col("url")).alias("url")).distinct(), ["capture", "url"], "left_anti"))
    # what can be queued is few rows of a capture, cut off by rank before they meet; the rest is marked without being sorted
    page = F.col("kind") == "page"
    place = F.row_number().over(Window.partitionBy("capture", "page").orderBy("position", "url"))
    few = new.withColumn("page", page).withColumn("place", place).where(F.col("place") <= max(max_pages, max_resources))
    few = few.where(~F.col("page") | (F.col("place") <= max_pages))
    queued = few.withColumn("n", F.row_number().over(Window.partitionBy("capture").orderBy("position", "url"))).where(F.col("n") <= max_resources)
    return new.join(queued.select("capture", "url", F.lit(True).alias("queued")), ["capture", "url"], "left").withColumn("queued", F.coalesce("queued", F.lit(False)))


def reachable(seeds: DataFrame, links: DataFrame, most_depth: int | None = None, hops: int = 8) -> DataFrame:
    """(url, depth): what seeds (url) reach over links (source, target), by breadth, to the end or at most so deep.

    A round follows several hops in one job and is stored; the loop ends when one leaves nothing at its last depth.
    """
    links = links.select("source", "target").where("source is not null and target is not null")
    found = materialized(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    newest = found
    for n in itertools.count(1):
        first = (n - 1) * hops
        last = n * hops if most_depth is None else min(n * hops, most_depth)
        if first >= last:
            break
        near = newest
        for depth in range(first, last):  # a row stays, and one of the present depth gives its targets the next
            step = near.join(links, F.expr(f"url = source and depth = {depth}"), "left")
            both = F.array(F.struct("url", "depth"), F.struct(F.col("target").alias("url"), F.lit(depth + 1).alias("depth")))
            near = step.select(F.inline(F.filter(both, lambda x: x["url"].isNotNull()))).groupBy("url").agg(F.min("depth").alias("depth"))
        new = materialized(near.join(found.select("url"), "url", "left_anti"))
        found, newest = found.unionByName(new), new.where(F.col("depth") == last)
        if newest.isEmpty():
            break
        if n % 16 == 0:
            found = materialized(found)  # plans stay small however deep links go
    return found
