"""A corpus from raw documents: toxicity, language, near-duplicates, source mix, packed sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Every stage works on whatever rows the stage before kept, also none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, minhash, mixing, packing, toxicity
from weftline.llm.shared import fresh, numbered, sendable, shared_dir, stored

#: A text whose letters take this many times the usual bits of the language nearest to it is in none of the learned ones; short texts can't tell.
STRANGE = 2.25


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a machine fitted on all their labels."""
    machine, score = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs.columns, "score")
    return toxicity.score(docs, machine, into=score).where(F.col(score) < 0.5).select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and are in one of the languages that the corpus itself names, as far as their letters can tell."""
    lang, score, times = (fresh(docs.columns, n) for n in ("lang_pred", "score", "times"))
    found = langid.identify(docs, langid.with_usual(docs, langid.train(docs)), into=(lang, score, times))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(times) < STRANGE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id (null last; of repeated rows one)."""
    row = fresh(docs.columns, "row")
    rows = numbered(docs, row)
    groups = minhash.near_duplicates(rows, row_col=row)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("first"))
    stay = stored(first.select(F.col("first.row_no").alias(row)))
    return rows.join(sendable(stay), row, "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    row, copies, copy = (fresh(docs.columns, n) for n in ("row", "copies", "copy"))
    rows = numbered(docs, row)
    taken = stored(mixing.mix(rows, row_col=row).where("copies > 0").select(F.col("row_no").alias(row), F.col("copies").alias(copies)))
    return rows.join(sendable(taken), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("language", in_a_language), ("near-duplicates", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: Fitted models, signatures and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{n}")
    return docs
