"""Names of files in an archive: each takes the first that is free of its path, -2, -3 and so on, in the order in which files come.

A name can be asked for by two paths only: as itself, and as a numbered name of the path without its last number. So paths form trees. Within a
tree a path's takers get rising numbers and leave out those that were taken as themselves before; what they leave out are few intervals of numbers, each passed
in one step. A path that lost its own name to the path above begins with its second number, so paths are numbered from the top of their trees down, all of a
level at once. Ranks, counts and offsets are running sums over ranges of rows; no tree, and no path of many takers, is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import materialized, sendable
from .ranks import joined, ranked, running, spread


def named(kept: DataFrame) -> DataFrame:
    """Adds local_path to resources (base_path, position, url, ...); position and url tell those of a path apart."""
    takers = materialized(ranked(kept, ["base_path"], ["position", "url"], "taker"))
    bases = materialized(takers.groupBy("base_path").agg(F.min(F.struct("position", "url")).alias("first")))
    above, number = paths.without_suffix(F.col("base_path"))
    numbered = bases.select(above.alias("parent"), number.alias("number"), F.col("base_path").alias("child"), "first").where("parent is not null")
    counted = numbered.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    there = materialized(counted.join(bases.select(F.col("base_path").alias("parent")), "parent"))
    if there.isEmpty():
        return takers.withColumn("local_path", paths.with_suffix(F.col("base_path"), F.col("taker"))).drop("taker")
    children = materialized(joined(materialized(numbered), there, ["parent"], "n"))
    parents = there.select("parent")
    level = parents.join(children.select(F.col("child").alias("parent")), "parent", "left_anti")
    numbers = lost = None
    while not (level := materialized(level)).isEmpty():
        own = materialized(_numbered(level, takers, children, lost))
        taken = own.where("number > 1").select(F.col("base_path").alias("parent"), "number").join(children, ["parent", "number"]).select(F.col("child").alias("base_path"))
        lost = materialized(lost.union(taken) if lost else taken)
        numbers = numbers.union(own) if numbers else own
        level = children.join(sendable(level), "parent", "left_semi").select(F.col("child").alias("parent")).join(parents, "parent", "left_semi")
    shifted = sendable(lost.withColumn("lost", F.lit(1)))
    told = takers.join(numbers, ["base_path", "taker"], "left").join(shifted, "base_path", "left")
    number = F.coalesce("number", F.col("taker") + F.coalesce("lost", F.lit(0)))
    return told.withColumn("local_path", paths.with_suffix(F.col("base_path"), number)).drop("taker", "number", "lost")


def _numbered(level: DataFrame, takers: DataFrame, children: DataFrame, lost: DataFrame | None) -> DataFrame:
    """(base_path, taker, number) of all takers of the paths of a level, none of which is above another."""
    few = sendable(level)
    claims = materialized(takers.join(few.select(F.col("parent").alias("base_path")), "base_path", "left_semi").select(F.col("base_path").alias("parent"), "position", "url", "taker"))
    kids = children.join(few, "parent", "left_semi")
    # a number is left out by the takers that come after the path that has it as its own name
    came = claims.select("parent", "position", "url", F.lit(1).alias("one"), F.lit(None).cast("long").alias("number")).unionByName(kids.select("parent", "first.position", "first.url", F.lit(0).alias("one"), "number"))
    order = ["position", "url", "one"]
    held = running(spread(came, ["parent"], order), ["parent"], order, F.col("one"), "before").where("one = 0").select("parent", "number", (F.col("before") + 1).alias("claim"))
    if lost:
        gone = level.join(lost.select(F.col("base_path").alias("parent")), "parent", "left_semi")
        held = held.unionByName(gone.select("parent", F.lit(1).cast("long").alias("number"), F.lit(1).cast("long").alias("claim")))
    placed = ranked(held, ["parent", "claim"], ["number"], "place")
    intervals = placed.groupBy("parent", "claim", (F.col("number") - F.col("place")).alias("apart")).agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("length"))
    skips = intervals.select("parent", "low", "length", "claim").repartition("parent").sortWithinPartitions("parent", "low").mapInArrow(_skips, "parent string, at long, skipped long")
    both = claims.select("parent", F.col("taker").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("skipped")).unionByName(skips.withColumn("kind", F.lit(0)))
    offsets = running(spread(both, ["parent"], ["at", "kind"]), ["parent"], ["at", "kind"], F.col("skipped"), "offset").where("kind = 1")
    return offsets.select(F.col("parent").alias("base_path"), F.col("at").alias("taker"), (F.col("at") + F.col("offset")).alias("number"))


def _skips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, at, skipped): from its taker at on, a path's numbers are higher by skipped; of intervals in the order of their numbers.

    An interval's numbers are left out by takers from claim on. While earlier ones are numbered they may still use up its beginning.
    """
    parent, offset = None, 0
    for batch in batches:
        out = []
        for own, low, length, claim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != parent:
                parent, offset = own, 0
            used = min(length, max(0, offset - (low - claim)))
            if used < length:
                out.append((own, low + used - offset, length - used))
                offset += length - used
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["parent", "at", "skipped"])
