"""Exact top-k by inner product in three phases with a uniform threshold.

The components of the vectors are split into PARTS, and a score is the sum of one partial score per part. Every (block of vectors, part) is a
list holder that computes the partial scores of a block of queries.

1. Each holder gives its k best partial scores and its lowest. The vectors of these lists are scored in full; the k-th best of them is a
   total that the k best of all reach.
2. A total that reaches it has in some part a share of at least the part's lowest plus an equal share of what the bound is above the sum of
   the lowest. This cutoff goes to every holder, which gives all that reaches it.
3. Vectors whose upper bound (cutoffs for parts not seen) reaches the k-th best lower bound are scored in full.

Products of components beyond 2 ** 55 fit no column of numbers. Pairs with such a vector are few or none: they are scored apart, in blocks, with
Python's whole numbers, and ranked beside the others by the bytes of their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .vectors import as_bytes, blocks, candidates, matrix, named, usable

PARTS = 2
BLOCK, QUERY_BLOCK = 4096, 256
SCALE = 1024
_EXACT = float(1 << 53)
#: Larger components (of floor(SCALE x)) make a vector wide; sums of the products of 4096 smaller ones fit 37 digits.
MOST = float(1 << 55)
_WIDE = "decimal(38,0)"


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exactly: as doubles where no sum can pass 2 ** 53, else as Python's numbers."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    if most < _EXACT:
        return q @ v.T
    whole = lambda m: np.array([[int(x) for x in line] for line in m], object).reshape(m.shape)
    return whole(q) @ whole(v).T


def whole_numbers(v: np.ndarray) -> list[int]:
    """floor(SCALE x) of finite doubles, exactly; from 2 ** 60 on all doubles are whole."""
    return [SCALE * int(x) if abs(x) >= 1 << 60 else int(np.floor(SCALE * x)) for x in v.tolist()]


def sort_key(score: int) -> bytes:
    """Bytes that are in the order of whole numbers: the sign, the length, the digits; a negative one's are those of its opposite, turned over."""
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    body = len(digits).to_bytes(4, "big") + digits
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - b for b in body)


def _shown(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _wide_best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score, key): the k best of each block of vectors for each query of a block, by Python's whole numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            own, theirs = batch.column(0)[i].values.to_pylist(), batch.column(2)[i].values.to_pylist()
            queries, vectors = ([whole_numbers(line) for line in matrix(batch.column(c)[i])] for c in (1, 3))
            out = []
            for query, q in zip(own, queries, strict=True):
                scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), vec) for vec, v in zip(theirs, vectors, strict=True) if vec != query)[:k]
                out += [(query, vec, _shown(-score), sort_key(-score)) for score, vec in scored]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score", "key"), row, strict=True)) for row in out], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())]))


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [int(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_shown(x) for x in scores], pa.int64()), pa.array([sort_key(x) for x in scores], pa.binary())], names=["query_id", "vec_id", "score", "key"])


_KEYED = "query_id long, vec_id long, score long, key binary"


def _beside_wide(ranked: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): ranked rows of pairs without wide vectors, and all pairs with one; of rows (vec_id, v, wide)."""
    found = ranked.select("query_id", "vec_id", "score").mapInArrow(_with_keys, _KEYED)
    for asked, held in ((queries.where("wide"), vectors), (queries.where("not wide"), vectors.where("wide"))):
        n = held.count()
        if n and not asked.isEmpty():
            groups = max(1, n // BLOCK)
            dealt = as_bytes(held.select("vec_id", "v")).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
            spread = as_bytes(asked.select("vec_id", "v")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
            q = blocks(spread, ["group"], QUERY_BLOCK).select("group", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
            pairs = q.join(blocks(dealt, ["group"], BLOCK), "group").select("q_ids", "q_vs", "ids", "vs")
            found = found.unionByName(pairs.mapInArrow(lambda batches: _wide_best(batches, k), _KEYED))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).drop("key")


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, part, v binary): floor(SCALE x) of the components, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at = np.asarray(column.offsets)
            flat = np.floor(SCALE * np.asarray(column.values, np.float64)[at[0] : at[-1]])
            lines = flat.reshape(batch.num_rows, -1)
            for part, own in enumerate(np.array_split(lines, PARTS, axis=1)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(own), part, np.int32)), pa.array([line.astype("<f8").tobytes() for line in own], pa.binary())], names=["vec_id", "part", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, part int, v binary")


def _holders(lists: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """Every block of queries beside every block of vectors of its part; queries are repeated for each of some groups of blocks."""
    dealt = lists.withColumn("group", F.pmod(F.col("block"), F.lit(groups)))
    spread = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return spread.select("part", "group", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), "cutoffs").join(dealt, ["part", "group"]).select("part", "q_ids", "q_vs", "cutoffs", "ids", "vs")


def _partial(batches: Iterator[pa.RecordBatch], k: int, phase: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k best of each block, and the lowest with vec_id null. Phase 2: all that reach the query's cutoff."""
    for batch in batches:
        for i in range(batch.num_rows):
            own, theirs = batch.column(1)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy()
            scores = products(matrix(batch.column(2)[i]), matrix(batch.column(5)[i]))
            cutoffs = batch.column(3)[i].values
            query, vector, value, low = [], [], [], []
            for j, line in enumerate(scores):
                others = np.flatnonzero(theirs != own[j])
                if not len(others):
                    continue
                if phase == 2:
                    least = cutoffs[j].as_py()
                    few = others if least is None else others[line[others] >= int(least)]
                else:
                    few = others if len(others) <= k else others[np.argpartition(-line[others], k - 1)[:k]]
                    low.append((own[j], int(line[others].min())))
                query.append(np.full(len(few), own[j]))
                vector.append(theirs[few])
                value.append(line[few])
            if not query:
                continue
            ids = np.concatenate([*query, np.array([x[0] for x in low], np.int64)])
            vec = pa.array(np.concatenate([*vector, np.zeros(len(low), np.int64)]), mask=np.arange(len(ids)) >= len(ids) - len(low))
            lows = [x[1] for x in low]
            if scores.dtype == object:
                kind = pa.decimal128(38, 0) if wide else pa.int64()
                all_scores = pa.array([Decimal(x) if wide else x for x in [*(x for y in value for x in y), *lows]], kind)
            else:
                all_scores = pa.array(np.concatenate([*value, np.array(lows, np.float64)]).astype(np.int64))
                all_scores = all_scores.cast(pa.decimal128(38, 0)) if wide else all_scores
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), batch.column(0)[i].as_py(), np.int32)), vec, all_scores], names=["query_id", "part", "vec_id", "partial"])


def _half(x: Column, kind: str) -> Column:
    """x / PARTS rounded down, of whole x >= 0, without doubles."""
    rest = x % F.lit(PARTS).cast(kind)
    if kind == "long":
        return F.call_function("div", x - rest, F.lit(PARTS).cast("long"))
    return ((x - rest) * F.lit(Decimal("0.5"))).cast(kind)


def search(vectors: DataFrame, queries_where, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(1024 x), exactly, ties to smaller ids.

    queries_where: the condition (on the id column) for a row to be a query; the query's own row is no candidate. Vectors that are null or hold
    null, NaN or infinite components take no part, nor do rows without id and vectors of unusual length. Rows of one id are vectors of their own: each may be found and, as a query, has k ranks. Ranks are by the exact products; only the score
    column, a long, ends at its largest and smallest number. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = usable(vectors, queries_where, id_col=id_col, vector_col=vector_col, zeros=True)
    rows = good.withColumn("wide", F.exists("v", lambda x: F.abs(x) > MOST / SCALE))
    some_wide = not rows.where("wide").isEmpty()
    plain = rows.where("not wide") if some_wide else good
    most, size = plain.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    kind = "long" if (SCALE * (most or 0) + 1) ** 2 * (size or 1) < _EXACT else _WIDE
    schema = f"query_id long, part int, vec_id long, partial {kind}"
    parts = stored(_integers(candidates(plain, k)))
    lists = stored(blocks(parts, ["part"], BLOCK))
    query_parts = stored(_integers(plain.where("asked")))
    groups = max(1, min(lists.count() // PARTS, 2 * spark.sparkContext.defaultParallelism))

    no_cutoff = query_parts.withColumn("cutoff", F.lit(None).cast(kind))
    first = stored(_holders(lists, _query_blocks(no_cutoff), groups).mapInArrow(lambda b: _partial(b, k, 1, kind == _WIDE), schema))
    lowest = first.where("vec_id is null").groupBy("query_id", "part").agg(F.min("partial").alias("low"))
    lows = lowest.groupBy("query_id").agg(F.sum("low").cast(kind).alias("sum_low"))
    gathered = _exact(first.where("vec_id is not null").select("query_id", "vec_id").distinct(), parts, query_parts, kind)
    bound = _kth(gathered.withColumnRenamed("score", "lower"), k, "reached")
    # what isn't known to be k good totals has no cutoff
    share = (F.col("low") + _half((F.col("reached") - F.col("sum_low")).cast(kind), kind)).cast(kind)
    cut = lowest.join(lows, "query_id").join(bound, "query_id", "left").withColumn("cutoff", F.when(F.col("reached").isNotNull(), share))
    cut = stored(cut.select("query_id", "part", "low", "sum_low", "cutoff"))

    asked = query_parts.join(cut.select(F.col("query_id").alias("vec_id"), "part", "cutoff"), ["vec_id", "part"])
    second = stored(_holders(lists, _query_blocks(asked), groups).mapInArrow(lambda b: _partial(b, k, 2, kind == _WIDE), schema))
    floor = F.coalesce("cutoff", F.col("low"))
    least = second.join(cut, ["query_id", "part"]).withColumn("over_low", (F.col("partial") - F.col("low")).cast(kind)).withColumn("over", (F.col("partial") - floor).cast(kind))
    tops = cut.groupBy("query_id").agg(F.sum(floor).cast(kind).alias("sum_cut"))
    met = least.groupBy("query_id", "vec_id").agg(F.sum("over_low").cast(kind).alias("above"), F.first("sum_low").alias("sum_low"), F.sum("over").cast(kind).alias("over_cut"), F.count(F.lit(1)).alias("n"))
    met = stored(met.withColumn("lower", (F.col("above") + F.col("sum_low")).cast(kind)))
    needed = _kth(met, k, "needed")
    upper = F.col("over_cut") + F.col("sum_cut")
    open_ = met.join(tops, "query_id").join(needed, "query_id", "left").where(F.col("needed").isNull() | (upper >= F.col("needed")))

    complete = open_.where(F.col("n") == PARTS).select("query_id", "vec_id", F.col("lower").alias("score"))
    resolved = _exact(open_.where(F.col("n") < PARTS).select("query_id", "vec_id"), parts, query_parts, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = complete.unionByName(resolved).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    if some_wide:
        return named(_beside_wide(ranked, rows.where("asked"), candidates(rows, k), k), good)
    ends = [F.lit(n).cast(kind) for n in (-(1 << 63), (1 << 63) - 1)]
    return named(ranked.withColumn("score", F.greatest(ends[0], F.least(ends[1], F.col("score"))).cast("long")), good)


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Blocks (part, block, ids, vs, cutoffs) of rows (vec_id, part, v, cutoff); without a cutoff everything reaches it."""
    n = queries.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / QUERY_BLOCK)).cast("long")
    packed = queries.join(n, "part").withColumn("block", block).groupBy("part", "block").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "v", F.col("cutoff").alias("cutoff"))).alias("rows"))
    return packed.select("part", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"), F.col("rows.cutoff").alias("cutoffs"))


def _kth(bounds: DataFrame, k: int, into: str) -> DataFrame:
    """(query_id, into): the k-th highest of ``lower``; no row where there are fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    return bounds.select("query_id", "lower").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("lower").alias(into))


def _exact(pairs: DataFrame, parts: DataFrame, query_parts: DataFrame, kind: str) -> DataFrame:
    """(query_id, vec_id, score) of pairs, over all parts."""
    q = query_parts.select(F.col("vec_id").alias("query_id"), "part", F.col("v").alias("q"))
    both = pairs.join(parts, "vec_id").join(q, ["query_id", "part"])
    scored = both.select("query_id", "vec_id", "q", "v").mapInArrow(lambda b: _scored(b, kind == _WIDE), f"query_id long, vec_id long, partial {kind}")
    return scored.groupBy("query_id", "vec_id").agg(F.sum("partial").cast(kind).alias("score"))


def _scored(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out, sizes = np.zeros(batch.num_rows, object if wide else np.int64), np.array([len(x) for x in q])
        for size in np.unique(sizes):  # parts may differ by one component
            own = np.flatnonzero(sizes == size)
            x, y = (np.frombuffer(b"".join([m[i] for i in own]), "<f8").reshape(len(own), -1) for m in (q, v))
            if not wide:
                out[own] = np.einsum("nd,nd->n", x, y).astype(np.int64)
            else:
                out[own] = [Decimal(int(products(a[None, :], b[None, :])[0, 0])) for a, b in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.decimal128(38, 0)) if wide else pa.array(out)], names=["query_id", "vec_id", "partial"])
