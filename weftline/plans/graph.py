"""Queries over the capture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, urls
from ..operators import graph
from ..sources import capture
from .views import NORMAL, REDIRECTS, REQUESTS, RESPONSES, with_


def first_body_per_url(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_body_per_url(capture.responses(spark, sf)).select("url", "content_hash", "size", "response_id", "preserve_url")


def api_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return graph.api_snapshots(capture.exchanges(spark, sf)).select("exchange_id", "method", F.col("normalized_url").alias("url"), "post_data", "status", "content_hash")


def replay_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.replay_exchanges(capture.exchanges(spark, sf))


def replay_misses(spark: SparkSession, sf: str) -> DataFrame:
    x = capture.exchanges(spark, sf)
    headers = F.create_map(F.lit("Content-Type"), F.col("content_type"))
    reason = graph.miss_reason(F.col("normalized_url"), F.col("resource_type"), headers, F.col("method"), F.col("body_state"), F.col("status"))
    return x.withColumn("reason_code", reason).where("reason_code is not null").select("exchange_id", "request_id", F.col("id").alias("response_id"), "reason_code", "status")


def provenance_counts(spark: SparkSession, sf: str) -> DataFrame:
    families = {"requests": capture.requests(spark, sf), "responses": capture.responses(spark, sf), "api_exchanges": capture.exchanges(spark, sf)}
    return graph.provenance_counts(families, capture.PROVENANCES)


def body_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return graph.body_provenance(capture.responses(spark, sf))


def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = capture.responses(spark, sf)
    return graph.record_counts({"requests": capture.requests(spark, sf), "responses": r, "bodies": r.select("body_id").where("body_id is not null").distinct(), "api_exchanges": capture.exchanges(spark, sf)})


def request_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = graph.request_variants(capture.requests(spark, sf))
    return v.select("url", "n", F.to_json(F.transform("variants", lambda x: F.concat_ws("|", x["id"], x["method"], F.coalesce(x["request_body_hash"], F.lit("-")), x["provenance"]))).alias("variants"))


def request_variant_rows(spark: SparkSession, sf: str) -> DataFrame:
    return graph.variant_rows(capture.requests(spark, sf))


def redirect_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return capture.redirects(spark, sf).select(F.col("id").alias("request_id"), "predecessor_id", "predecessor_url", "original_url", "normalized_url")


def redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Page p redirects to page p / 2 unless it is a resource (p divisible by 5); page 1 and 0 turn in a circle unless 0 is a resource."""
    pages = capture.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://p.test/"), "page_id").alias("url"))
    target = pages.select(F.col("page_id").alias("to"), F.col("url").alias("target"))
    links = pages.where("page_id % 5 <> 0").join(target, F.floor(F.col("page_id") / 2) == F.col("to")).select("url", "target", F.lit("redirect").alias("kind"))
    return graph.closure(links, pages.where("page_id % 5 = 0").select("url")).select("url", "resource", "hops")


def body_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return graph.body_aliases(capture.responses(spark, sf))


def rendered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A route for each page whose document is the page; every tenth page's route has an alias."""
    pages = capture.table(spark, sf, "pages")
    key = F.col("page_id")
    routes = pages.select(F.concat(F.lit("route-"), key).alias("id"), F.col("url").alias("route_url"), F.when(key % 4 == 0, "skipped").otherwise("captured").alias("state"), F.concat(F.lit("document-"), key).alias("document_id"), F.when(key % 10 == 1, F.array(F.concat(F.lit("alias-"), key))).alias("alias_route_ids"))
    bodies = pages.select(F.concat(F.lit("body-"), key).alias("id"), paths.content_hash(F.col("html")).alias("content_hash"), F.octet_length("html").cast("long").alias("size"))
    documents = pages.select(F.concat(F.lit("document-"), key).alias("id"), F.concat(F.lit("body-"), key).alias("body_id"))
    return graph.rendered_pages(routes, documents, bodies)


def graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Records with faults planted by rule: odd provenances, bodies that are missing, ids that occur twice."""
    q = capture.requests(spark, sf).select("id", F.when(F.col("event_id") % 97 == 0, "guessed").otherwise(F.col("provenance")).alias("provenance"))
    r = capture.responses(spark, sf)
    answers = r.select(F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("request-"), F.col("sequence"))).otherwise(F.col("id")).alias("id"), "request_id", "provenance", F.when(F.col("event_id") % 89 == 0, F.concat(F.lit("body-lost-"), F.col("sequence"))).otherwise(F.col("body_id")).alias("body_id"), F.when(F.col("event_id") % 83 == 0, "partial").otherwise(F.col("body_state")).alias("body_state"))
    bodies = r.where("body_id is not null").groupBy(F.col("body_id").alias("id")).agg(F.first("content_hash").alias("content_hash"), F.first("size").alias("size"))
    return graph.violations({"requests": q, "responses": answers, "bodies": bodies}, capture.PROVENANCES)


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Pages discovered, less those excluded (page_id divisible by 17), and those saved (page_id not divisible by 5)."""
    pages = capture.table(spark, sf, "pages").select("page_id", urls.normalized(F.col("url")).alias("url"))
    by_url = pages.groupBy("url").agg(F.bool_or(F.col("page_id") % 17 == 0).alias("excluded"), F.bool_or(F.col("page_id") % 5 != 0).alias("saved")).where("not excluded")
    n, saved = F.col("discovered"), F.col("saved")
    counted = by_url.agg(F.count(F.lit(1)).alias("discovered"), F.count_if("saved").alias("saved"))
    return counted.select("discovered", "saved", (n - saved).alias("unresolved"), F.when(n > 0, F.floor((2000 * saved + n) / (2 * n)) / 10).otherwise(100.0).cast("double").alias("score"))


QUERIES = {f.__name__: f for f in (first_body_per_url, api_snapshots, replay_exchanges, replay_misses, provenance_counts, body_provenance, record_counts, request_variants, request_variant_rows, redirect_pairs, redirect_closure, body_aliases, rendered_pages, graph_violations, completeness)}

_COUNT_FAMILIES = " UNION ALL ".join(f"SELECT '{f}' AS family, provenance FROM {t}" for f, t in (("requests", "requests"), ("responses", "responses"), ("api_exchanges", "exchanges")))
_PROVENANCES = ", ".join(f"('{p}')" for p in capture.PROVENANCES)

ORACLE_SQL = {
    "first_body_per_url": with_(RESPONSES,
        "SELECT normalized_url AS url, arg_min(content_hash, (ts, sequence)) AS content_hash, arg_min(size, (ts, sequence)) AS size, arg_min(id, (ts, sequence)) AS response_id, bool_or(resource_type IN ('Fetch', 'XHR')) AS preserve_url "
        "FROM responses WHERE body_id IS NOT NULL GROUP BY 1"),
    "api_snapshots": with_(RESPONSES,
        "SELECT exchange_id, method, normalized_url AS url, coalesce(request_body, '') AS post_data, status, content_hash FROM exchanges WHERE body_id IS NOT NULL "
        "AND status BETWEEN 200 AND 299 QUALIFY row_number() OVER (PARTITION BY method, normalized_url, coalesce(request_body, '') ORDER BY ts, sequence) = 1"),
    "replay_exchanges": with_(RESPONSES,
        f"SELECT exchange_id, sequence, method, normalized_url AS url, content_type, coalesce(request_body_hash, '{paths.EMPTY_HASH}') AS request_body_hash, coalesce(request_body, '') AS post_data, status, mime_type, content_hash, body_id IS NOT NULL AS body_available, provenance "
        f"FROM exchanges"),
    "replay_misses": with_(RESPONSES,
        "SELECT * FROM (SELECT exchange_id, request_id, id AS response_id, CASE WHEN method NOT IN ('GET', 'HEAD', 'POST') THEN 'unknown-mutation' WHEN body_state <> 'stored' "
        "AND status NOT IN (204, 205, 301, 302, 303, 307, 308) THEN 'response-body-unavailable' END AS reason_code, status FROM exchanges) WHERE reason_code IS NOT NULL"),
    "provenance_counts": with_(RESPONSES,
        f", counted AS (SELECT family, provenance, count(*) AS n FROM ({_COUNT_FAMILIES}) GROUP BY 1, 2) SELECT f.family, p.provenance, coalesce(n, 0) AS n "
        f"FROM (VALUES ('requests'), ('responses'), ('api_exchanges')) f(family) CROSS JOIN (VALUES {_PROVENANCES}) p(provenance) LEFT JOIN counted c ON c.family = f.family "
        f"AND c.provenance = p.provenance"),
    "body_provenance": with_(RESPONSES, "SELECT provenance, count(DISTINCT body_id) AS bodies FROM responses WHERE body_id IS NOT NULL GROUP BY 1"),
    "record_counts": with_(RESPONSES,
        "SELECT 'requests' AS family, count(*) AS n FROM requests UNION ALL SELECT 'responses', count(*) FROM responses UNION ALL SELECT 'bodies', count(DISTINCT body_id) "
        "FROM responses UNION ALL SELECT 'api_exchanges', count(*) FROM exchanges"),
    "request_variants": with_(REQUESTS,
        "SELECT normalized_url AS url, count(*) AS n, '[' || string_agg('\"' || concat_ws('|', id, method, coalesce(request_body_hash, '-'), provenance) || '\"', ',' "
        "ORDER BY sequence) || ']' AS variants FROM requests GROUP BY 1 HAVING count(*) > 1"),
    "request_variant_rows": with_(REQUESTS,
        "SELECT * FROM (SELECT normalized_url AS url, count(*) OVER u AS n, row_number() OVER (PARTITION BY normalized_url "
        "ORDER BY sequence) AS place, id, method, request_body_hash, provenance FROM requests WINDOW u AS (PARTITION BY normalized_url)) WHERE n > 1"),
    "redirect_pairs": with_(REDIRECTS, "SELECT id AS request_id, predecessor_id, predecessor_url, original_url, normalized_url FROM redirects"),
    "redirect_closure":
        f"WITH RECURSIVE p AS (SELECT page_id, 'https://p.test/' || page_id AS url FROM pages), walk AS (SELECT page_id AS start, page_id AS here, 0 AS hops FROM p UNION ALL "
        f"SELECT start, here // 2, hops + 1 FROM walk WHERE here % 5 <> 0 AND here > 1) SELECT a.url, b.url AS resource, w.hops FROM p a LEFT JOIN (SELECT * FROM (SELECT start, "
        f"CASE WHEN here % 5 <> 0 AND here = 1 THEN 0 ELSE here END AS here, CASE WHEN here % 5 <> 0 AND here = 1 THEN hops + 1 ELSE hops END AS hops FROM walk "
        f"WHERE here % 5 = 0 OR here = 1)) w ON w.start = a.page_id LEFT JOIN p b ON b.page_id = w.here",
    "body_aliases": with_(RESPONSES,
        "SELECT body_id, any_value(content_hash) AS content_hash, any_value(size) AS size, count(*) AS n_responses, count(DISTINCT normalized_url) AS n_urls, min(sequence) AS first_sequence "
        "FROM responses WHERE body_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "rendered_pages":
        "WITH p AS (SELECT page_id, url, 'sha256:' || sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size FROM pages WHERE page_id % 4 <> 0) "
        "SELECT 'route-' || page_id AS route_id, 'route-' || page_id AS owner_route_id, url AS route_url, content_hash, size FROM p UNION ALL "
        "SELECT 'alias-' || page_id, 'route-' || page_id, url, content_hash, size FROM p WHERE page_id % 10 = 1",
    "graph_violations": with_(RESPONSES,
        ", a AS (SELECT CASE WHEN event_id % 101 = 0 THEN 'request-' || sequence ELSE id END AS id, provenance, "
        "CASE WHEN event_id % 89 = 0 THEN 'body-lost-' || sequence ELSE body_id END AS body_id, CASE WHEN event_id % 83 = 0 THEN 'partial' ELSE body_state END AS body_state "
        "FROM responses), ids AS (SELECT id, 'requests' AS family FROM requests UNION ALL SELECT id, 'responses' FROM a UNION ALL SELECT DISTINCT body_id, 'bodies' FROM responses "
        "WHERE body_id IS NOT NULL) SELECT 'duplicate-id' AS rule, min(family) AS family, id, CAST(count(*) AS VARCHAR) AS detail FROM ids GROUP BY id HAVING count(*) > 1 "
        "UNION ALL SELECT 'unknown-provenance', 'requests', id, 'guessed' FROM requests WHERE event_id % 97 = 0 UNION ALL SELECT 'dangling-body-id', 'responses', id, body_id "
        "FROM a WHERE body_id LIKE 'body-lost-%' UNION ALL SELECT 'body-state', 'responses', id, body_state FROM a WHERE body_state = 'partial'"),
    "completeness":
        f"WITH u AS (SELECT {NORMAL.format('url')} AS url, bool_or(page_id % 17 = 0) AS excluded, bool_or(page_id % 5 <> 0) AS saved FROM pages "
        f"GROUP BY 1), c AS (SELECT count(*) AS discovered, count(*) FILTER (WHERE saved) AS saved FROM u WHERE NOT excluded) "
        f"SELECT discovered, saved, discovered - saved AS unresolved, CAST(CASE WHEN discovered > 0 THEN ((2000 * saved + discovered) // (2 * discovered)) / 10.0 ELSE 100 END AS DOUBLE) AS score "
        f"FROM c",
}
