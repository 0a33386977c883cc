"""Queries written in SQL alone, and orders by the rules of a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sql
from ..operators import graph
from ..sources import capture
from .content import ORACLE_SQL as _CONTENT


def _said(spark: SparkSession, sf: str, query: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(query.format(**{t: f"parquet.`{sf}/{t}.parquet`" for t in ("pages", "events", "documents")}))


def sql_html_references(spark: SparkSession, sf: str) -> DataFrame:
    return _said(spark, sf, "SELECT CAST(p.page_id AS STRING) AS owner, r.n, r.syntax, r.role, r.raw AS raw_value, r.start, r.`end` FROM {pages} p, LATERAL html_references(p.html) r")


def sql_metadata(spark: SparkSession, sf: str) -> DataFrame:
    query = """SELECT event_id, get_json_object(s.json, '$.session') AS session, get_json_object(s.json, '$.at') AS at, size(s.findings) AS found
      FROM (SELECT event_id, sanitized_metadata(concat('{{"session":"s","props":', props, ',"at":"https://u:p@h.test/?key=abcdefghijkl"}}')) AS s FROM {events})"""
    return _said(spark, sf, query)


def sql_links(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page how many links it has, by the first character of what they name, and how many pages have such a link."""
    return _said(spark, sf, "SELECT substr(r.raw, 1, 2) AS starts, count(*) AS links, count(DISTINCT p.page_id) AS pages FROM {pages} p, LATERAL html_references(p.html) r WHERE r.role = 'navigation' AND r.tag = 'a' GROUP BY 1")


def _spelled(spark: SparkSession, sf: str) -> DataFrame:
    """Exchanges of one moment for all pages of a remainder, with ids in mixed case and with accents."""
    k, word = F.col("page_id"), F.regexp_extract("url", "([a-z]{2})[a-z]*[^a-z]*$", 1)
    spelled = F.when(k % 5 == 0, F.upper(word)).when(k % 5 == 1, F.initcap(word)).when(k % 5 == 2, F.translate(word, "aeiou", "áéíóú")).when(k % 5 == 3, F.translate(word, "aeiou", "àèìòù")).otherwise(word)
    none = F.lit(None).cast("string")
    return capture.table(spark, sf, "pages").select(
        F.concat(spelled, k % 3).alias("exchange_id"), (k % 11).alias("sequence"), F.lit("GET").alias("method"), F.col("url").alias("normalized_url"), F.lit("").alias("content_type"), none.alias("request_body_hash"), none.alias("request_body"), F.lit(200).alias("status"),
        F.lit("text/html").alias("mime_type"), none.alias("content_hash"), none.alias("body_id"), F.lit("observed").alias("provenance"),
    )


def replay_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of exchanges of equal sequence, in the order in which they are replayed."""
    exchanges = graph.replay_exchanges(_spelled(spark, sf)).select("sequence", "exchange_id").distinct()
    return exchanges.withColumn("place", F.row_number().over(Window.partitionBy("sequence").orderBy(graph.by_language("exchange_id"), "exchange_id")))


QUERIES = {f.__name__: f for f in (sql_html_references, sql_metadata, sql_links, replay_order)}

ORACLE_SQL = {
    "sql_html_references": f"SELECT owner, n, syntax, role, raw_value, start, \"end\" FROM ({_CONTENT['html_references']})",
    "sql_metadata": _CONTENT["sanitized_metadata"],
    "sql_links": "SELECT substr(h, 1, 2) AS starts, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY 1",
    "replay_order": """WITH w AS (SELECT page_id, regexp_extract(url, '([a-z]{2})[a-z]*[^a-z]*$', 1) AS word FROM pages),
x AS (SELECT DISTINCT page_id % 11 AS sequence, CASE page_id % 5 WHEN 0 THEN upper(word) WHEN 1 THEN upper(substr(word, 1, 1)) || substr(word, 2) WHEN 2 THEN translate(word, 'aeiou', 'áéíóú') WHEN 3 THEN translate(word, 'aeiou', 'àèìòù') ELSE word END || (page_id % 3) AS exchange_id FROM w)
SELECT sequence, exchange_id, row_number() OVER (PARTITION BY sequence ORDER BY exchange_id COLLATE de, exchange_id) AS place FROM x""",
}
