"""Crawls in rounds: what is queued is visited, what visits tell is merged, what they find is fed back, until every crawl's queue or budget is at its end.

The state of all crawls is a table of their records, stored each round; a round visits the next route of every crawl at once, so crawls go on side by side and each
as if it were alone. A crawl has at most max_candidates + 1 records, so what a task holds of it is small; what a page shows beyond them is cut off by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import urls
from ..sources.tables import materialized
from .crawl import Policy, shaped

#: Records of a crawl in the order in which they were made. keys: what a route answers for; alias_of: the record that answers in its place.
_KINDS = {
    "n": T.IntegerType(), "route_url": T.StringType(), "transition_kind": T.StringType(), "state": T.StringType(), "reason": T.StringType(), "keys": T.ArrayType(T.StringType()), "final_url": T.StringType(), "canonical_url": T.StringType(),
    "alias_of": T.IntegerType(), "bytes": T.LongType(), "elapsed_ms": T.LongType(), "turn": T.IntegerType(), "taken": T.BooleanType(),
}
_COLUMNS = list(_KINDS)
_STATE_FIELDS = [T.StructField(n, k) for n, k in _KINDS.items()]

Visit = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def planned(seeds: DataFrame, visit: Visit, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """All records of crawls (crawl, n, route_url, transition_kind, state, reason, final_url, canonical_url, alias_of, bytes, elapsed_ms, turn) once they have ended; turn is the round of a visit.

    seeds: (crawl, seed_url). visit takes routes (crawl, n, route_url, transition_kind) and gives results (crawl, n, final_url, canonical_url, bytes, elapsed_ms, failed) and found
    candidates (crawl, position, url, base_url, element_kind, target, download, form_action, transition_kind). failed: why a visit failed, else null; elapsed_ms: the crawl's time so far.
    A route without result counts as captured. The seed is a crawl's first route. Time and bytes are asked before each visit and each route that is taken up.
    """
    stored = T.StructType([T.StructField("crawl", seeds.schema["crawl"].dataType), *_STATE_FIELDS])
    seeds = materialized(seeds.select("crawl", urls.resolved(F.col("seed_url"), F.col("seed_url")).alias("seed_url")).where("seed_url is not null"))
    key = urls.route_key(F.col("seed_url"), F.lit("document"))
    none = lambda t: F.lit(None).cast(t)
    state = seeds.select(
        "crawl", F.lit(0).alias("n"), F.col("seed_url").alias("route_url"), F.lit("document").alias("transition_kind"), F.lit("visiting").alias("state"), F.lit("rendered-navigation").alias("reason"), F.array(key).alias("keys"),
        none("string").alias("final_url"), none("string").alias("canonical_url"), none("int").alias("alias_of"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("elapsed_ms"), F.lit(0).alias("turn"), F.lit(True).alias("taken"),
    )
    turn = 0
    while True:
        state = materialized(state)
        going = state.where("state = 'visiting'")
        if going.isEmpty():
            return state.drop("keys", "taken")
        turn += 1
        results, found = visit(going.select("crawl", "n", "route_url", "transition_kind"))
        told = results.select("crawl", "n", F.col("final_url").alias("final_"), F.col("canonical_url").alias("canonical_"), F.col("bytes").alias("bytes_"), F.col("elapsed_ms").alias("elapsed_"), "failed")
        most = F.row_number().over(Window.partitionBy("crawl").orderBy("position"))
        found = found.withColumn("rank_", most).where(F.col("rank_") <= policy.max_candidates + 1).join(seeds, "crawl")
        found = shaped(found, F.col("seed_url")).select(F.col("crawl").alias("of_crawl"), "position", "route_url", "transition_kind", "key", "fixed")
        records = state.join(told, ["crawl", "n"], "left").groupBy("crawl").agg(F.collect_list(F.struct(*_COLUMNS, "final_", "canonical_", "bytes_", "elapsed_", "failed")).alias("records"))
        offered = found.groupBy("of_crawl").agg(F.collect_list(F.struct("position", "route_url", "transition_kind", "key", "fixed")).alias("found"))
        state = records.join(offered, F.col("crawl") == F.col("of_crawl"), "left").select("crawl", "records", "found").mapInArrow(_rounds(policy, turn, stored), stored)


def _number(x: int | None) -> int:
    return 0 if x is None else int(x)


def _rounds(policy: Policy, turn: int, stored: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round of each crawl of a batch: rows (crawl, records, found) to the crawls' records."""
    schema, step = to_arrow_schema(stored), _step(policy, turn)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for c in batch.to_pylist() for r in step(c["crawl"], c["records"], c["found"] or [])]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return rounds


def _step(policy: Policy, turn: int) -> Callable[[object, list[dict], list[dict]], list[dict]]:
    """One crawl's round: its visit is merged, its candidates are judged in order, and its next route is taken up."""

    def step(crawl: object, records: list[dict], found: list[dict]) -> list[dict]:
        rows = sorted((r | {"crawl": crawl, "keys": r["keys"] or []} for r in records), key=lambda r: r["n"])
        owner = {key: r for r in rows for key in r["keys"]}
        for r in rows:
            if r["state"] == "visiting":
                _visited(r, owner, turn)
        ended = lambda: "time-budget" if max(_number(r["elapsed_ms"]) for r in rows) >= policy.max_duration_ms else "byte-budget" if sum(_number(r["bytes"]) for r in rows) >= policy.max_bytes else None
        for c in sorted(found, key=lambda c: c["position"]):
            if len(rows) >= policy.max_candidates:
                if not any(r["reason"] == "candidate-budget" for r in rows):
                    rows.append(_record(crawl, len(rows), c, "skipped", "candidate-budget"))
                break
            accepted = [r for r in rows if r["taken"]]
            reason, of = c["fixed"], None
            if reason is None and c["key"] in owner:
                reason, of = "duplicate-route", owner[c["key"]]["n"]
            if reason is None:
                reason = ended() or ("page-budget" if len(accepted) >= policy.max_pages else "state-budget" if c["transition_kind"] == "history" and sum(r["transition_kind"] == "history" for r in accepted) >= policy.max_history_states else None)
            rows.append(_record(crawl, len(rows), c, "skipped" if reason else "accepted", reason or "same-origin-anchor", alias_of=of))
            if not reason:
                rows[-1]["keys"], rows[-1]["taken"] = [c["key"]], True
                owner[c["key"]] = rows[-1]
        queue = [r for r in rows if r["state"] == "accepted"]
        if queue and (over := ended()):
            for r in queue:
                r["state"], r["reason"] = "skipped", over
        elif queue:
            queue[0]["state"], queue[0]["reason"], queue[0]["turn"] = "visiting", "rendered-navigation", turn
        return rows

    return step


def _record(crawl: object, n: int, c: dict, state: str, reason: str, *, alias_of: int | None = None) -> dict:
    return {"crawl": crawl, "n": n, "route_url": c["route_url"], "transition_kind": c["transition_kind"], "state": state, "reason": reason, "keys": [], "final_url": None, "canonical_url": None, "alias_of": alias_of, "bytes": 0, "elapsed_ms": 0, "turn": None, "taken": False}


def _visited(r: dict, owner: dict[str, dict], turn: int) -> None:
    """A failed visit, or one that answers for its own, its final and its canonical URL; another route of such a key is skipped, visited or not."""
    r["elapsed_ms"] = _number(r["elapsed_"])
    final, canonical, failed = r["final_"], r["canonical_"], r["failed"]
    if failed:
        r["state"] = "skipped" if failed == "cancelled" or failed.endswith("budget") else "failed"
        r["reason"], r["final_url"] = failed, final
        return
    r["state"], r["reason"], r["bytes"] = "captured", "rendered-captured", _number(r["bytes_"])
    r["final_url"], r["canonical_url"] = final or r["route_url"], canonical
    for url in dict.fromkeys(u for u in (r["route_url"], final, canonical) if u):
        key = f"{r['transition_kind']}:{url if r['transition_kind'] == 'history' else url.partition('#')[0]}"
        other = owner.get(key, r)
        if other is not r:
            other["state"], other["reason"], other["alias_of"] = "skipped", "canonical-alias" if url == canonical else "redirect-alias", r["n"]
            other["keys"] = [k for k in other["keys"] if k != key]
        owner[key] = r
        if key not in r["keys"]:
            r["keys"].append(key)
