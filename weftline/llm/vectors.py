"""What the two vector searches share: which vectors take part, and packing rows into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import document_columns, numbered


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def usable(vectors: DataFrame, queries_where: Column | str, *, id_col: str, vector_col: str, zeros: bool) -> DataFrame:
    """(vec_id, id, asked, v array<double>), stored: the rows that take part. id is the caller's, asked tells the queries, and vec_id numbers the rows
    in the order of their ids, so that rows of one id are told apart and ties go as the ids say.

    Rows without id or with an unusable vector are left out, so are vectors of another length than most have (of two equally
    frequent lengths the larger counts), as no distance or product is defined for them.
    """
    v, id_ = F.col("v"), F.col(id_col)
    plain = document_columns(vectors, id_col, vector_col)
    asked = F.coalesce(F.expr(queries_where) if isinstance(queries_where, str) else queries_where, F.lit(False))
    plain = plain.select(id_.cast("long").alias("id"), asked.alias("asked"), F.col(vector_col).cast("array<double>").alias("v"))
    good = plain.where(F.col("id").isNotNull() & finite(v) & (F.lit(True) if zeros else F.exists(v, lambda x: x != 0)))
    lengths = good.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).select("length")
    # numbers made of sorted rows rise with them
    return numbered(good.join(F.broadcast(usual), F.size("v") == F.col("length"), "left_semi").orderBy("id", "v"), "vec_id")


def named(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) by ids, of found rows by row numbers."""
    ids = rows.select("vec_id", "id")
    by_vector = found.join(ids, "vec_id").withColumnRenamed("id", "found_id")
    by_query = by_vector.join(ids.select(F.col("vec_id").alias("query_id"), F.col("id").alias("own_id")), "query_id")
    return by_query.select(F.col("own_id").alias("query_id"), "rank", F.col("found_id").alias("vec_id"), "score")


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Without the rows that can't be among any query's k best: of equal vectors all but the k + 1 first.

    Equal vectors have equal scores and ties go to smaller ids, so this changes no result.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    return vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def as_bytes(vectors: DataFrame) -> DataFrame:
    """v as little-endian doubles in a binary column."""
    others = [c for c in vectors.columns if c != "v"]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            flat, at = np.asarray(column.values, "<f8"), np.asarray(column.offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=[*others, "v"])

    return vectors.mapInArrow(run, f"{kinds}, v binary")


def blocks(rows: DataFrame, keys: list[str], size: int, *, ids: str = "vec_id") -> DataFrame:
    """Packs rows (keys, ids, v binary) of equal keys into rows (keys, block, ids array, vs array) of about size rows each."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    split = rows.join(counts, keys)
    block = F.pmod(F.xxhash64(ids), F.ceil(F.col("n") / size)).cast("long")
    packed = split.withColumn("block", block).groupBy(*keys, "block").agg(F.collect_list(F.struct(F.col(ids).alias("id"), "v")).alias("rows"))
    return packed.select(*keys, "block", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))


def matrix(vs: pa.Scalar) -> np.ndarray:
    """The vectors of a block as lines of doubles."""
    n = len(vs.values)
    return np.frombuffer(b"".join(vs.values.to_pylist()), "<f8").reshape(n, -1)
