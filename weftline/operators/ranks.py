"""Ranks and running sums over groups of any size, and joins that no frequent key holds up.

Rows are dealt out by ranges of (keys, order) and stored with the number of their range. A sum runs within each range, and the totals of the ranges before are
added, so a group that holds most rows is as many tasks as its share of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized


def spread(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df, stored by ranges of keys and order, with the range of each row as part. Keys must not be null."""
    return materialized(df.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))


def running(dealt: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Spread rows with the sum of value over the rows of the same keys up to their own; keys and order must tell rows apart, or equal ones be alike."""
    own = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "part").agg(F.sum(value).alias("total_"))
    before = totals.select(*keys, "part", F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("before_"))
    return dealt.withColumn(into, F.sum(value).over(own)).join(before, [*keys, "part"]).withColumn(into, (F.col(into) + F.col("before_")).cast("long")).drop("before_", "part")


def ranked(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """df with the place of each row among those of the same keys, from 1."""
    return running(spread(df, keys, order), keys, order, F.lit(1), into)


def joined(left: DataFrame, right: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """Inner join with stored rows that have one row for each key and, in the column n, how many rows of left have it, which is dropped.

    Keys of more than one in share of left's rows are share at most; what belongs to them is sent to all tasks, the rest is shuffled.
    """
    most = F.lit(max(1, left.count() // share))
    heavy, light = right.where(F.col(n) > most).drop(n), right.where(F.col(n) <= most).drop(n)
    if heavy.isEmpty():
        return left.join(light, keys)
    return left.join(F.broadcast(heavy), keys).unionByName(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))
