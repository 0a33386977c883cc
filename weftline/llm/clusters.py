"""Centroid clustering in whole numbers by annulus search.

Centroids are sorted by their norms. What is nearer to a vector than u has a norm within u of the vector's, so the distance to the centroids whose
norms stand beside the vector's own bounds an annulus; a binary search finds the centroids in it, and only these are compared, exactly. The bounds are inclusive
and a little wide, so ties at the boundary are compared too.

A round is one pass over the vectors: tasks add up components by cluster, Spark adds up the tasks, and what reaches the driver are k x dims sums.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import document_columns, stored
from .vectors import finite

#: Components up to here have squared distances over 64 components that fit a long; beyond, Python's numbers are used.
NARROW = 1 << 27
#: Sums are sent in parts of so many bits, which Spark adds up as decimals, so that none is too large.
LIMB_BITS = 40
_MOST = (1 << 63) - 1


def scaled(x: float, scale: int) -> int:
    """floor(scale x) of a finite double, exactly; from 2 ** 60 on all doubles are whole."""
    return scale * int(x) if abs(x) >= 1 << 60 else int(np.floor(scale * x))


@dataclass(frozen=True)
class Rings:
    """Centroids in the order of their norms, and the number of each."""

    centroids: list[list[int]]
    number: list[int]
    norms: list[int]

    @staticmethod
    def of(centroids: list[list[int]]) -> Rings:
        square = [sum(x * x for x in c) for c in centroids]
        order = sorted(range(len(centroids)), key=lambda i: (square[i], i))
        return Rings([centroids[i] for i in order], order, [isqrt(square[i]) for i in order])

    @property
    def narrow(self) -> bool:
        return all(-NARROW <= x <= NARROW for c in self.centroids for x in c)

    def nearest(self, v: list[int]) -> tuple[int, int]:
        """(number, squared distance) of the nearest centroid to a vector of whole numbers, ties to the smaller number."""
        norm = isqrt(sum(x * x for x in v))
        at = bisect_left(self.norms, norm)
        beside = {min(max(i, 0), len(self.norms) - 1) for i in (at - 1, at)}
        away = lambda i: sum((a - b) ** 2 for a, b in zip(v, self.centroids[i], strict=True))
        reach = isqrt(min(map(away, beside))) + 2  # roots are rounded down
        inside = range(bisect_left(self.norms, norm - reach), bisect_right(self.norms, norm + reach))
        square, number = min((away(i), self.number[i]) for i in inside)
        return number, square

    def nearest_of_all(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for lines of small whole numbers (int64) and narrow centroids."""
        c, number = np.array(self.centroids, np.int64), np.array(self.number)
        norms = np.sqrt((c * c).sum(1).astype(np.float64))
        own = np.sqrt((v * v).sum(1).astype(np.float64))
        at = np.searchsorted(norms, own)
        reach = np.full(len(v), np.inf)
        for i in (np.maximum(at - 1, 0), np.minimum(at, len(c) - 1)):
            reach = np.minimum(reach, np.sqrt(((v - c[i]) ** 2).sum(1).astype(np.float64)))
        reach = reach * (1 + 1e-9) + own * 1e-9 + 1e-6  # more than the roots' errors
        first, last = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
        best, winner = np.full(len(v), _MOST), np.full(len(v), len(c))
        for j in range(len(c)):
            inside = np.flatnonzero((first <= j) & (j < last))
            square = ((v[inside] - c[j]) ** 2).sum(1)
            better = (square < best[inside]) | ((square == best[inside]) & (number[j] < winner[inside]))
            best[inside[better]], winner[inside[better]] = square[better], number[j]
        return winner, best


def _assigned(batch: pa.RecordBatch, rings: Rings, dims: int, scale: int) -> tuple[np.ndarray, list[int], np.ndarray, dict[int, list[int]]]:
    """Cluster and squared distance of each row of a batch, small whole numbers (0 where they aren't small), and the others by row."""
    column = batch.column(batch.num_columns - 1)
    at = np.asarray(column.offsets)
    v = np.asarray(column.values, np.float64)[at[0] : at[-1]].reshape(batch.num_rows, dims)
    small = (np.abs(v).max(axis=1, initial=0) < NARROW / scale) & rings.narrow
    whole = np.floor(scale * np.where(small[:, None], v, 0)).astype(np.int64)
    winner, square = rings.nearest_of_all(whole) if rings.narrow else (np.zeros(len(v), np.int64), np.zeros(len(v), np.int64))
    squares, large = square.tolist(), {}
    for i in np.flatnonzero(~small).tolist():
        large[i] = [scaled(x, scale) for x in v[i].tolist()]
        winner[i], squares[i] = rings.nearest(large[i])
    return winner, squares, whole, large


def _sums(batches: Iterator[pa.RecordBatch], rings: Rings, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(cluster, dim, limb, part) of a task: sums of the components by cluster in limbs; dim -1 is the count."""
    k = len(rings.number)
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for batch in batches:
        winner, _, whole, large = _assigned(batch, rings, dims, scale)
        for j in np.unique(winner).tolist():
            own = winner == j
            counts[j] += int(own.sum())
            sums[j] = [a + b for a, b in zip(sums[j], whole[own].sum(0).tolist(), strict=True)]
        for i, v in large.items():
            sums[winner[i]] = [a + b for a, b in zip(sums[winner[i]], v, strict=True)]
    rows = []
    for j in range(k):
        for dim, total in [(-1, counts[j]), *enumerate(sums[j])] if counts[j] else []:
            sign, rest, limb = (1 if total >= 0 else -1), abs(total), 0
            while rest or not limb:
                rows.append((j, dim, limb, sign * (rest & ((1 << LIMB_BITS) - 1))))
                rest, limb = rest >> LIMB_BITS, limb + 1
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "dim", "limb", "part"])


def _moved(points: DataFrame, rings: Rings, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after a round: of each cluster floor(sum / count), componentwise; an empty one stays."""
    dims = len(centroids[0])
    parts = points.mapInArrow(lambda batches: _sums(batches, rings, dims, scale), "cluster int, dim int, limb int, part long")
    totals: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():  # k x (dims + 1) x limbs rows at most
        totals[r["cluster"], r["dim"]] = totals.get((r["cluster"], r["dim"]), 0) + (int(r["part"]) << (LIMB_BITS * r["limb"]))
    return [[totals[j, dim] // totals[j, -1] for dim in range(dims)] if (j, -1) in totals else c for j, c in enumerate(centroids)]


@dataclass(frozen=True)
class Clusters:
    """assigned: (id, cluster, distance) of every vector that is kept, stored; centroids: the last ones, by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Clusters vectors of floor(scale x) by squared Euclidean distance, ties to the smaller number; each of some rounds assigns all and moves the centroids to
    the floored means, then all are assigned once more.

    Vectors count that have exactly dims components, none of them null, NaN or infinite; others are left out. The first centroids are those k whose
    hex sha256 of "seed:id" is smallest (rows of one id by their components; rows without id come last but are clustered like others). Repeated rows are vectors of
    their own. Numbers of any size are compared exactly; only the distance column, a long, ends at its largest number. An empty table gives no rows and no centroids.
    """
    plain = document_columns(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    points = plain.where((F.size("v") == dims) & finite(F.col("v")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    firsts = points.withColumn("drawn", drawn).orderBy(F.col("drawn").asc_nulls_last(), "id", "v").limit(k).collect()
    centroids = [[scaled(x, scale) for x in r["v"]] for r in firsts]
    id_type = points.schema["id"].dataType.simpleString()
    if not centroids:
        return Clusters(stored(points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)), [])
    for _ in range(rounds):
        centroids = _moved(points.select("v"), Rings.of(centroids), centroids, scale)
    rings = Rings.of(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            winner, squares, _, _ = _assigned(batch, rings, dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(winner.astype(np.int32)), pa.array([min(x, _MOST) for x in squares], pa.int64())], names=["id", "cluster", "distance"])

    return Clusters(stored(points.mapInArrow(assign, f"id {id_type}, cluster int, distance long")), centroids)


def digest(centroid: list[int]) -> str:
    """Hex sha256 of the components as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _total(distance: Column) -> Column:
    """A sum of longs, which ends at the largest of them."""
    return F.least(F.sum(distance.cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")


def with_inertia(found: Clusters) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; a row for each of the k clusters is sent along."""
    spark = found.assigned.sparkSession
    by_cluster = {r["cluster"]: r["total"] for r in found.assigned.groupBy("cluster").agg(_total(F.col("distance")).alias("total")).collect()}
    inertia = min(sum(by_cluster.values()), _MOST)
    rows = [(j, by_cluster.get(j, 0), inertia, digest(c)) for j, c in enumerate(found.centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
