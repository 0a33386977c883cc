"""Intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sendable(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A stored table of narrow rows, marked to be sent to all tasks if it has at most most_rows rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder in that of spark.checkpoint.dir, which all machines share; local sessions that name none get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Written to a shared folder and read back: lineage ends, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, each: int = 4) -> DataFrame:
    """Rows of a table of fewer splits than several for each core, dealt evenly before costly steps; a table of more splits stays as it is.

    A file's splits may be empty, as only whole row groups are read: a file of one is one task, however many splits it has.
    """
    tasks = each * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
