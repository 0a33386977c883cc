"""Capture records derived from the events and pages tables by a fixed mapping (see FIXTURES.md).

Orders are kept as columns (ts, sequence), never as one global count, so that nothing is numbered in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, urls
from .tables import dealt

PROVENANCES = ("observed", "refetched", "derived", "inferred", "user-supplied")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provenance(event_id: Column) -> Column:
    return F.when(event_id % 7 == 0, "refetched").when(event_id % 11 == 0, "derived").otherwise("observed")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event on the page of its user."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages").select("page_id", "url")
    kind = F.col("event_type")
    method = F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").when((kind == "view") & (F.col("event_id") % 10 == 0), "HEAD").otherwise("GET")
    return e.join(p, F.col("user_id") == F.col("page_id")).select(
        F.concat(F.lit("request-"), F.col("event_id") + 1).alias("id"), (F.col("event_id") + 1).alias("sequence"), "event_id", "user_id", (F.col("user_id") % 20).alias("mission_id"), "ts", "event_type",
        method.alias("method"), F.col("url").alias("original_url"), urls.normalized(F.col("url")).alias("normalized_url"), F.when(method == "POST", F.col("props")).alias("request_body"),
        F.when(method == "POST", paths.content_hash(F.col("props"))).alias("request_body_hash"), F.when(method == "POST", "application/json").otherwise("").alias("content_type"), provenance(F.col("event_id")).alias("provenance"),
    )


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.content_hash(F.col("html")).alias("content_hash"), F.octet_length("html").cast("long").alias("size"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of each request; HEAD and PUT have no body."""
    kind = F.col("event_type")
    r = requests(spark, sf_dir).join(page_bodies(spark, sf_dir), F.col("user_id") == F.col("page_id")).drop("page_id")
    stored = ~F.col("method").isin("HEAD", "PUT")
    resource = F.when(kind == "view", "Document").when(kind.isin("click", "error"), "XHR").otherwise("Fetch")
    return r.select(
        F.concat(F.lit("response-"), F.col("sequence")).alias("id"), F.col("id").alias("request_id"), "sequence", "event_id", "user_id", "mission_id", "ts", "event_type", "method", "normalized_url", "request_body", "request_body_hash", "content_type", "provenance",
        F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200).alias("status"), resource.alias("resource_type"), F.when(stored, F.concat(F.lit("body-"), F.col("content_hash"))).alias("body_id"),
        F.when(stored, F.col("content_hash")).alias("content_hash"), F.when(stored, F.col("size")).alias("size"), F.when(stored, "stored").otherwise("not-applicable").alias("body_state"), F.lit("text/html").alias("mime_type"), (F.col("event_id") % 3 == 0).alias("from_service_worker"),
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API exchanges: click, purchase, error and signup responses."""
    return responses(spark, sf_dir).where(F.col("event_type").isin("click", "purchase", "error", "signup")).withColumn("exchange_id", F.concat(F.lit("exchange-"), F.col("sequence")))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose predecessor (the same user's request before) redirected to them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = requests(spark, sf_dir).withColumn("before", F.lag(F.struct("id", "event_id", "original_url")).over(order))
    return before.where(F.col("before.event_id") % 13 == 0).withColumn("predecessor_id", F.col("before.id")).withColumn("predecessor_url", F.col("before.original_url"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages in order: (page_id, position, base_url, href)."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    return dealt(table(spark, sf_dir, "pages")).select("page_id", F.col("url").alias("base_url"), F.posexplode(hrefs).alias("position", "href"))


def child_targets(attached: DataFrame, roots: DataFrame) -> DataFrame:
    """Targets of frames and workers (mission_id, target_id, session_id, type, url), each below the root target (mission_id, id) of its mission."""
    return attached.join(roots.select("mission_id", F.col("id").alias("parent_target_id")), "mission_id", "left").select(
        "mission_id", F.concat(F.lit("target-"), "target_id").alias("id"), F.coalesce("type", F.lit("worker")).alias("target_type"), "session_id", F.coalesce("url", F.lit("")).alias("original_url"), "parent_target_id", F.lit("observed").alias("provenance"),
    )


def cache_entries(entries: DataFrame) -> DataFrame:
    """What a browser's caches hold (mission_id, cache_id, n, url, method, status, mime_type, body binary) as exchanges, each with its request, response and body.

    Entries of other schemes and without success are left out.
    """
    good = entries.where(F.rlike("url", F.lit("(?i)^https?:")) & F.col("status").between(200, 299))
    key = F.concat_ws("-", F.col("cache_id").cast("string"), F.col("n").cast("string"))
    return good.select(
        F.concat(F.lit("exchange-"), key).alias("exchange_id"), F.concat(F.lit("request-"), key).alias("request_id"), F.concat(F.lit("response-"), key).alias("response_id"), "mission_id", F.coalesce("method", F.lit("GET")).alias("method"),
        F.col("url").alias("original_url"), urls.normalized(F.col("url")).alias("normalized_url"), "status", F.coalesce("mime_type", F.lit("")).alias("mime_type"), F.lit("CacheStorage").alias("resource_type"), F.lit("browser-cache").alias("classification"),
        paths.content_hash(F.col("body")).alias("content_hash"), F.octet_length("body").cast("long").alias("size"), F.lit("observed").alias("provenance"),
    )
