"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split again and again into halves of equal size; the means of the parts are the centroids. Centroids are
held in memory with links to their neighbours, and the nearest to a vector are found by walking that graph. Every
vector goes to the posting list of its nearest centroid and, near a boundary, of others whose distance is hardly larger; a list of many
vectors is several blocks, so none is a task of its own. A query reads the lists of the nearest centroids as far as their
distance stays within a ratio of the smallest, and scores what they hold exactly. How many it reads at most is found on the table
itself: it is raised until a sample of the queries, held against all vectors, finds enough of its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .vectors import as_bytes, blocks, candidates, matrix, named, usable


@dataclass(frozen=True)
class Settings:
    """sample: rows that centroids are made from at most; list_size: vectors a list is meant to hold, which sets the number of
    centroids up to most_centroids; replicas, boundary: a vector goes to so many lists at most, within (1 + boundary) times the smallest distance;
    lists, ratio: a query reads so many lists at most, within (1 + ratio) times the smallest distance, as long as a sample of
    measured queries finds recall of its nearest with that; more are read where it doesn't."""

    sample: int = 40_000
    list_size: int = 160
    most_centroids: int = 8192
    replicas: int = 4
    boundary: float = 0.12
    lists: int = 128
    ratio: float = 0.6
    recall: float = 0.95
    measured: int = 128
    degree: int = 24
    block: int = 1024


@dataclass
class CentroidGraph:
    """Centroids, their neighbours in the graph, and where searches begin."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    def search(self, vectors: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of the k nearest centroids found, nearest first, by best-first walks of all vectors at once."""
        n, total = len(vectors), len(self.centroids)
        k = min(k, total)
        beam = min(total, max(k, beam))
        norms = (self.centroids**2).sum(1)
        if 4 * beam >= total:  # a walk would come by most of them
            square = norms - 2 * vectors @ self.centroids.T
            number = np.argsort(square, axis=1, kind="stable")[:, :k]
            square = np.take_along_axis(square, number, 1) + (vectors**2).sum(1)[:, None]
            return number, np.sqrt(np.maximum(square, 0))
        known = np.zeros((n, total), bool)
        line = np.arange(n)[:, None]
        number = np.broadcast_to(self.entries, (n, len(self.entries)))
        known[:, self.entries] = True
        distance = norms[number] - 2 * vectors @ self.centroids[self.entries].T
        done = np.zeros(number.shape, bool)
        while True:
            if number.shape[1] > beam:
                best = np.argpartition(distance, beam - 1, axis=1)[:, :beam]
                distance, number, done = (np.take_along_axis(x, best, 1) for x in (distance, number, done))
            waiting = np.where(done, np.inf, distance)
            if np.isinf(waiting).all():
                break
            steps = min(4, waiting.shape[1])
            walk = np.argpartition(waiting, steps - 1, axis=1)[:, :steps]  # the nearest that weren't followed yet
            np.put_along_axis(done, walk, True, 1)
            near = np.sort(self.neighbours[np.take_along_axis(number, walk, 1)].reshape(n, -1), axis=1)
            fresh = ~known[line, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            known[line, near] = True
            width = int(fresh.sum(1).max())
            if not width:
                continue
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, front, 1), np.take_along_axis(fresh, front, 1)
            square = norms[near] - 2 * np.matmul(self.centroids[near], vectors[:, :, None])[:, :, 0]
            distance = np.concatenate([distance, np.where(fresh, square, np.inf)], 1)
            number, done = np.concatenate([number, near], 1), np.concatenate([done, ~fresh], 1)
        order = np.argsort(distance, axis=1, kind="stable")[:, :k]
        square = np.take_along_axis(distance, order, 1) + (vectors**2).sum(1)[:, None]
        return np.take_along_axis(number, order, 1), np.sqrt(np.maximum(square, 0))


def balanced_centroids(sample: np.ndarray, n: int, *, seed: int = 5) -> np.ndarray:
    """Means of at least n (if there are so many different vectors) parts of equal size, found by splitting in halves."""
    sample = np.unique(sample, axis=0)
    random = np.random.default_rng(seed)
    parts = [sample]
    while len(parts) < n and max(map(len, parts)) > 1:
        halves = []
        for part in parts:
            if len(part) == 1:
                halves.append(part)
                continue
            a, b = part[random.choice(len(part), 2, replace=False)]
            for _ in range(4):
                lean = part @ (a - b)
                near = np.argsort(-lean, kind="stable")
                a, b = part[near[: len(part) // 2]].mean(0), part[near[len(part) // 2 :]].mean(0)
            near = np.argsort(-(part @ (a - b)), kind="stable")
            halves += [part[near[: len(part) // 2]], part[near[len(part) // 2 :]]]
        parts = halves
    return np.unique(np.array([part.mean(0) for part in parts]), axis=0)


def centroid_graph(sample: np.ndarray, n: int, degree: int, *, seed: int = 5) -> CentroidGraph:
    """The centroids of a sample of one vector or more, each linked to its degree nearest and to two anywhere."""
    centroids = balanced_centroids(sample, n).astype(np.float32)
    total = len(centroids)
    random = np.random.default_rng(seed)
    norms = (centroids**2).sum(1)
    near = []
    for lo in range(0, total, 1024):
        square = norms[None, :] - 2 * centroids[lo : lo + 1024] @ centroids.T
        near.append(np.argpartition(square, min(degree, total - 1), axis=1)[:, : min(degree + 1, total)])
    far = random.integers(0, total, (total, 2))  # a few links across, so that every part is reached
    entries = random.choice(total, min(total, max(32, int(4 * total**0.5))), replace=False)
    return CentroidGraph(centroids, np.concatenate([np.concatenate(near), far], 1), np.union1d(entries, spread_entries(centroids, (len(entries) + 1) // 2)))


def spread_entries(centroids: np.ndarray, n: int) -> np.ndarray:
    """n centroids, each the farthest from those before it, so that walks also begin in small groups that lie apart."""
    norms = (centroids**2).sum(1)
    chosen, apart = [0], np.full(len(centroids), np.inf, np.float32)
    while len(chosen) < n:
        apart = np.minimum(apart, norms - 2 * centroids @ centroids[chosen[-1]] + norms[chosen[-1]])
        apart[chosen] = -np.inf
        chosen.append(int(apart.argmax()))
    return np.sort(np.array(chosen))


def _assigned(vectors: DataFrame, graph, settings: Settings) -> DataFrame:  # noqa: ANN001
    """(list, vec_id, v): each vector in its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = graph.value.centroids
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f8").reshape(part.num_rows, -1).astype(np.float32)
                number, distance = graph.value.search(v, 2 * settings.replicas, 32)
                keep = distance <= (1 + settings.boundary) * distance[:, :1]
                for j in range(1, number.shape[1]):  # a list that is nearer to one already chosen than to the vector adds little
                    for i in range(j):
                        apart = np.sqrt(((centroids[number[:, i]] - centroids[number[:, j]]) ** 2).sum(1))
                        keep[:, j] &= ~keep[:, i] | (apart >= 0.5 * distance[:, j])
                keep &= np.cumsum(keep, 1) <= settings.replicas
                row, at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(number[row, at].astype(np.int64)), *(part.column(c).take(pa.array(row)) for c in (0, 1))], names=["list", "vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, "list long, vec_id long, v binary")


def _near_enough(distance: np.ndarray, ratio: float) -> np.ndarray:
    """Which lists a query reads, of ascending distances; where lists lie on the query itself the smallest is no scale: the fourth is used."""
    return distance <= (1 + ratio) * distance[:, min(3, distance.shape[1] - 1)][:, None]


def _nearest_of_all(vectors: DataFrame, ids: np.ndarray, v: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, v): the k nearest of all vectors to each of a few queries."""
    asked = vectors.sparkSession.sparkContext.broadcast((ids, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's k best for each query, given once at its end."""
        ids, queries = asked.value
        held = [(np.zeros(0), np.zeros(0, np.int64), []) for _ in ids]
        for batch in batches:
            theirs, vs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            x = np.frombuffer(b"".join(vs), "<f8").reshape(batch.num_rows, -1)
            for n, (own, q) in enumerate(zip(ids, queries, strict=True)):
                score = np.sqrt(((x - q) ** 2).sum(1))
                score[theirs == own] = np.inf
                few = np.lexsort((theirs, score))[:k]
                few = few[np.isfinite(score[few])]
                scores, found, kept = np.concatenate([held[n][0], score[few]]), np.concatenate([held[n][1], theirs[few]]), held[n][2] + [vs[i] for i in few]
                best = np.lexsort((found, scores))[:k]
                held[n] = (scores[best], found[best], [kept[i] for i in best])
        for own, (scores, found, kept) in zip(ids, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own)), pa.array(found), pa.array(kept, pa.binary()), pa.array(scores)], names=["query_id", "vec_id", "v", "score"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, v binary, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("n", best).where(F.col("n") <= k).select("query_id", "vec_id", "v")


def _measured(queries: DataFrame, vectors: DataFrame, graph, settings: Settings, k: int) -> Settings:  # noqa: ANN001
    """The settings, with as many more lists as a sample of the queries needs to find recall of its k nearest; at last all lists, which hold every vector."""
    total = len(graph.value.centroids)
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.measured).toPandas()
    if asked.empty:
        return settings
    ids, v = asked["vec_id"].to_numpy(), np.frombuffer(b"".join(asked["v"]), "<f8").reshape(len(asked), -1)
    nearest = _nearest_of_all(vectors, ids, v, k)
    homes = _assigned(nearest.select("vec_id", "v").distinct(), graph, settings).select("vec_id", "list")
    wanted = nearest.select("query_id", "vec_id").join(homes, "vec_id").toPandas()
    if wanted.empty:
        return settings
    number, distance = graph.value.search(v.astype(np.float32), total, total)
    at = np.argsort(number, axis=1)  # the place of each list in a query's order
    line = wanted["query_id"].map({q: n for n, q in enumerate(ids)}).to_numpy()
    wanted["place"] = at[line, wanted["list"].to_numpy()]
    wanted["near"] = _near_enough(distance, settings.ratio)[line, wanted["place"].to_numpy()]
    n = len(wanted[["query_id", "vec_id"]].drop_duplicates())
    lists = settings.lists
    while True:
        seen = wanted[wanted["near"] & (wanted["place"] < lists)]
        if len(seen[["query_id", "vec_id"]].drop_duplicates()) >= settings.recall * n:
            return replace(settings, lists=lists)
        if lists >= total:
            return replace(settings, lists=total, ratio=np.inf)
        lists *= 2


def _read_lists(queries: DataFrame, graph, settings: Settings) -> DataFrame:  # noqa: ANN001
    """(list, vec_id, v): each query with the lists it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f8").reshape(part.num_rows, -1).astype(np.float32)
                number, distance = graph.value.search(v, settings.lists, 2 * settings.lists)
                rows, places = np.nonzero(_near_enough(distance, settings.ratio))
                for first in range(0, len(rows), 1 << 14):
                    row, at = rows[first : first + (1 << 14)], places[first : first + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(number[row, at].astype(np.int64)), *(part.column(c).take(pa.array(row)) for c in (0, 1))], names=["list", "vec_id", "v"])

    return queries.select("vec_id", "v").mapInArrow(run, "list long, vec_id long, v binary")


def _nearest_in_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own, theirs = batch.column(0)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
            q, v = matrix(batch.column(1)[i]), matrix(batch.column(3)[i])
            out = []
            for query, x in zip(own, q, strict=True):
                score = np.sqrt(((v - x) ** 2).sum(1))
                score[theirs == query] = np.inf
                if len(score) > k:
                    few = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])  # with all ties
                else:
                    few = np.arange(len(score))
                few = few[np.isfinite(score[few])]
                few = few[np.lexsort((theirs[few], score[few]))][:k]
                out.append((np.full(len(few), query), theirs[few], score[few]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])


def _all_against(queries: DataFrame, vectors: DataFrame, settings: Settings, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each block of vectors to each query, by reading all of them."""
    groups = max(1, vectors.count() // (16 * settings.block))
    dealt = vectors.withColumn("list", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    spread = queries.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asked = blocks(spread, ["list"], 256).select("list", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    pairs = asked.join(blocks(dealt, ["list"], settings.block), "list").select("q_ids", "q_vs", "ids", "vs")
    return pairs.mapInArrow(lambda batches: _nearest_in_blocks(batches, k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries_where, settings: Settings = Settings(), *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: ANN001, B008
    """(query_id, rank, vec_id, score) of the k nearest vectors found by Euclidean distance, ties to smaller ids.

    queries_where: the condition (on the id column) for a row to be a query; the query's own row is no candidate. Vectors that are null, zero or hold null,
    NaN or infinite components take no part, nor do rows without id and vectors of unusual length. Rows of one id are vectors of their own: each may be found and,
    as a query, has k ranks. Where the lists that a query reads hold fewer than k candidates, all vectors are searched for it.
    An empty table gives an empty result.

    How many lists are read rises until measured queries find settings.recall of their nearest (at last all lists are), so recall is what is bounded, not the work.
    """
    spark = vectors.sparkSession
    rows_taking_part = usable(vectors, queries_where, id_col=id_col, vector_col=vector_col, zeros=False)
    good = stored(as_bytes(rows_taking_part.drop("id")))
    n = good.count()
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.frombuffer(b"".join(rows["v"]), "<f8").reshape(len(rows), -1)
    graph = spark.sparkContext.broadcast(centroid_graph(sample, min(settings.most_centroids, -(-n // settings.list_size)), settings.degree))
    others, queries = stored(candidates(good, k).select("vec_id", "v")), good.where("asked").select("vec_id", "v")
    there = others.count()
    settings = _measured(queries, others, graph, settings, k)
    lists = blocks(_assigned(others, graph, settings), ["list"], settings.block)
    asked = blocks(_read_lists(queries, graph, settings), ["list"], 256)
    pairs = asked.select("list", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")).join(lists, "list").select("q_ids", "q_vs", "ids", "vs")
    found = pairs.mapInArrow(lambda batches: _nearest_in_blocks(batches, k), "query_id long, vec_id long, score double")
    # a vector may have been found in several lists
    best = stored(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    counted = queries.select(F.col("vec_id").alias("query_id"), "v").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    # a query is among the candidates or, as one of many equal vectors, isn't; either way so many others are there
    short = stored(counted.where(F.coalesce("n", F.lit(0)) < min(k, there - 1)).select(F.col("query_id").alias("vec_id"), "v"))
    if not short.isEmpty():
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_all_against(short, others, settings, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named(best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k), rows_taking_part)
