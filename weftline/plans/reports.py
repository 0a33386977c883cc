"""Queries over reports: evidence, parity, diagnostics, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, paths
from ..operators import graph, references, reports
from ..sources import capture
from .views import REQUESTS, RESPONSES, normal, origin, pathname, with_


def edge_targets(spark: SparkSession, sf: str) -> DataFrame:
    """An edge for each page to its own URL, every other without a target; refetched responses answer."""
    r = capture.responses(spark, sf).where("provenance = 'refetched'").select("id", "normalized_url", "sequence")
    pages = capture.requests(spark, sf).groupBy("normalized_url").agg(F.min("user_id").alias("page_id"))
    edges = pages.select(F.col("page_id"), "normalized_url", F.when(F.col("page_id") % 2 == 0, "known").alias("target_evidence_id"), F.lit("unresolved").alias("disposition"))
    return reports.linked_edges(edges, r).select("page_id", "target_evidence_id", "disposition")


def route_recovery(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    p = capture.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://r.test/"), key).alias("u"))
    none = F.lit(None).cast("string")
    routes = p.select(F.concat(F.lit("route-"), key).alias("id"), F.col("u").alias("route_url"), F.when(key % 3 == 0, "failed").otherwise("captured").alias("state"), none.alias("decision_reason"), none.alias("final_url"), none.alias("document_id"), none.alias("fidelity"))
    refetched = p.where("page_id % 2 = 0").select(F.col("u").alias("url"), F.concat("u", F.lit("/final")).alias("final_url"), F.concat(F.lit("document-"), key).alias("document_id"))
    return reports.recovered_routes(routes, refetched).select("id", "state", "final_url", "document_id")


def body_parity(spark: SparkSession, sf: str) -> DataFrame:
    """First bodies against a catalog that lost every seventh page and keeps every fifth under an alias only."""
    first = graph.first_body_per_url(capture.responses(spark, sf)).select("url", "mime_type", "content_hash", "preserve_url", F.regexp_extract("request_id", r"(\d+)$", 1).cast("int").alias("k"))
    kept = first.where("k % 7 <> 0").select(F.when(F.col("k") % 5 == 0, F.concat("url", F.lit("/other"))).otherwise(F.col("url")).alias("url"), F.when(F.col("k") % 5 == 0, F.array("url")).alias("aliases"), "mime_type", "content_hash", F.lit(True).alias("preserve_url"), F.lit(False).alias("route_page"))
    return reports.body_mismatches(first, kept).select("url")


def snapshot_parity(spark: SparkSession, sf: str) -> DataFrame:
    s = capture.exchanges(spark, sf).select(F.col("sequence").alias("position"), "normalized_url", "method", "status")
    return reports.snapshot_mismatches(s, s.where("position % 10 <> 0").withColumn("status", F.when(F.col("position") % 7 == 0, 1).otherwise(F.col("status"))), ("normalized_url", "method", "status"))


def entry_documents(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    p = capture.table(spark, sf, "pages").withColumn("url", F.concat(F.lit("https://e.test/"), key))
    captures = p.select(F.concat("url", F.lit("#x")).alias("page_url"), F.when(key % 2 == 0, "quick").otherwise("deep").alias("capture_mode"), (key % 3 == 0).alias("needs_live_dom"), F.lit("<p>live").alias("captured_html"))
    bodies = p.select("url", F.when(key % 5 == 0, "text/plain").otherwise("text/HTML; charset=x").alias("mime_type"), key.alias("position"), F.col("html").alias("text"))
    return reports.entry_html(captures, bodies).select("page_url", "method", F.length("html").alias("length"))


def merged_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.merged_diagnostics(capture.table(spark, sf, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 3).cast("string").alias("reason"), (F.col("event_id") % 4).alias("count")))


def report_lists(spark: SparkSession, sf: str) -> DataFrame:
    items = capture.requests(spark, sf).select(F.col("mission_id").alias("report"), F.col("event_type").alias("type"), F.col("sequence").alias("position"), F.col("normalized_url").alias("item"))
    return reports.bounded_items(items, 5)


def run_stability(spark: SparkSession, sf: str) -> DataFrame:
    runs = capture.table(spark, sf, "events").select((F.col("user_id") % 50).alias("fixture"), F.col("event_id").alias("run"), F.when(F.col("event_id") % 701 == 0, "odd").otherwise("even").alias("signature"), (F.col("event_id") % 97).alias("duration_ms"), (F.col("event_id") % 89).alias("size"))
    return reports.stability(runs)


def normal_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    p = capture.table(spark, sf, "pages")
    return p.select("page_id", reports.normal_diagnostic(F.concat(F.lit("TypeError at ("), "url", F.lit(":12:34)"))).alias("text"))


def persisted_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return reports.persisted(capture.responses(spark, sf).where("body_id is not null").select("body_id", "size").distinct())


def latest_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Each event changes its user's route: errors set the reason, all but views the state."""
    u = capture.table(spark, sf, "events").select("user_id", F.col("event_id").alias("sequence"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("state"), F.when(F.col("event_type") == "error", F.concat(F.lit("error-"), "event_id")).alias("reason"))
    return reports.latest(u, "user_id")


def source_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts of whole pages as comments, with the name of a map at their end."""
    k = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, "https://other.test/a.map").when(F.col("page_id") % 3 == 1, F.concat(F.lit("/maps/"), k, F.lit(".map"))).otherwise(F.concat(k, F.lit(".map")))
    text = F.concat(F.lit("/* "), "html", F.lit(" */ x();\n//# sourceMappingURL="), name)
    t = capture.table(spark, sf, "pages").select(k.alias("owner"), F.concat(F.lit("https://m.test/js/"), k, F.lit(".js")).alias("base_url"), text.alias("text"))
    return reports.source_map_urls(t)


def import_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with an import map behind them."""
    k = F.col("page_id").cast("string")
    text = F.concat("html", F.lit('<script type="importmap">{"imports":{"a":"./a'), k, F.lit('.js","b":"/b.js","c":"bare"}}</script>'))
    t = capture.table(spark, sf, "pages").select(k.alias("owner"), F.concat(F.lit("https://m.test/p/"), k).alias("base_url"), text.alias("text"))
    return reports.import_map_urls(t)


def gltf_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with whole pages as a member; every fifth page as it is, which is no JSON."""
    k = F.col("page_id").cast("string")
    page = F.to_json(F.struct(F.col("html").alias("html")))
    text = F.when(F.col("page_id") % 5 == 0, F.col("html")).otherwise(F.concat(F.lit('{"extras":'), page, F.lit(',"buffers":[{"uri":"b'), k, F.lit('.bin"},{"uri":"data:x"}],"images":{"one":[{"uri":"../i.png"}]}}')))
    t = capture.table(spark, sf, "pages").select(k.alias("owner"), F.lit("https://m.test/g/x.gltf").alias("base_url"), text.alias("text"))
    return reports.gltf_urls(t)


def hydration(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts of whole source pages, some with one planted that hydrates."""
    key = F.col("page_id")
    source = F.concat(F.when(key % 2 == 0, "<script>self.$R=1</script><script>other()</script>").otherwise("<script>other()</script>"), "html")
    html = F.when(key % 3 == 0, '<body><script type="module" src="/m.js"></script></body>').otherwise("<body><p></BODY>")
    return capture.table(spark, sf, "pages").select("page_id", reports.restored_hydration(html, source).alias("html"))


def form_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    s = capture.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit('{"redactedFields":'), F.col("page_id") % 3, F.lit(',"password":"x"}')).alias("json"))
    return reports.form_findings(s).select("id", "json", "found", "masked")


def child_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A frame or worker for each page, below the root of its mission; every tenth mission has no root."""
    k = F.col("page_id")
    attached = capture.table(spark, sf, "pages").select((k % 20).alias("mission_id"), k.alias("target_id"), F.concat(F.lit("s-"), k).alias("session_id"), F.when(k % 3 == 0, "iframe").alias("type"), F.when(k % 4 > 0, F.col("url")).alias("url"))
    roots = spark.range(20).where("id % 10 <> 9").select(F.col("id").alias("mission_id"), F.concat(F.lit("root-"), "id").alias("id"))
    return capture.child_targets(attached, roots)


def cache_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    entries = capture.table(spark, sf, "pages").select((k % 20).alias("mission_id"), (k % 5).alias("cache_id"), k.alias("n"), F.when(k % 9 == 0, "chrome-extension://x").otherwise(F.col("url")).alias("url"), F.lit(None).cast("string").alias("method"), (F.lit(200) + k % 4 * 50).alias("status"), F.lit("text/html").alias("mime_type"), F.col("html").cast("binary").alias("body"))
    return capture.cache_entries(entries).select("exchange_id", "request_id", "response_id", "method", "normalized_url", "status", "content_hash", "size", "resource_type", "classification")


def header_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Headers as lists with a repeated name, as maps."""
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    m = capture.requests(spark, sf).select("event_id", media.header_map(F.array(h("Referer", F.lit("a")), h("X-Body", F.col("request_body")), h("Referer", F.col("original_url")), h("Content-Type", F.col("content_type")))).alias("m"))
    return m.select("event_id", F.col("m")["Referer"].alias("referer"), F.col("m")["X-Body"].alias("posted"), F.col("m")["Content-Type"].alias("type"), F.size("m").alias("names"))


def state_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first letters of whole pages, without what isn't ASCII."""
    return capture.table(spark, sf, "pages").select("page_id", paths.fingerprint(F.substring(F.regexp_replace("html", "[^\\x00-\\x7F]", ""), 1, 200)).alias("fingerprint"))


def runtime_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages as text in a page and as JSON in a script."""
    p = capture.table(spark, sf, "pages")
    return p.select("page_id", F.sha2(reports.escaped_html(F.concat("html", F.lit("'"))), 256).alias("escaped"), reports.runtime_json(F.struct(F.lit("</script>`").alias("a"), "page_id")).alias("json"), F.contains(reports.runtime_json(F.struct("html")), F.lit("<")).alias("open"))


def shown_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.octet_length("html").cast("long") * F.element_at(F.array(*[F.lit(x).cast("long") for x in (0, 1, 300, 300_000, 300_000_000)]), (F.col("page_id") % 5 + 1).cast("int"))
    return capture.table(spark, sf, "pages").select("page_id", media.scaled_bytes(n).alias("shown"))


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that three overlapping lists say is pending, once."""
    p = capture.table(spark, sf, "pages").select("page_id", F.lit("page").alias("kind"))
    return reports.distinct_diagnostics(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0"), p.where("page_id % 5 = 0"))


def fetchable_references(spark: SparkSession, sf: str) -> DataFrame:
    """Of whole pages with an image, a link and a data URL before them, what would be fetched."""
    t = capture.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("owner"), F.col("url").alias("base_url"), F.concat(F.lit('<img src="../i.png"><a href="/x">x</a><img src="data:,"><img src="mailto:x">'), "html").alias("text"))
    return references.fetchable(references.discover(t, "html")).select("owner", "n", "resolved_url")


QUERIES = {f.__name__: f for f in (edge_targets, route_recovery, body_parity, snapshot_parity, entry_documents, merged_diagnostics, report_lists, run_stability, normal_diagnostics, persisted_bodies, latest_routes, source_maps, import_maps, gltf_files, hydration, form_snapshots, child_targets, cache_exchanges, header_maps, state_fingerprints, runtime_texts, shown_sizes, pending_work, fetchable_references)}

ORACLE_SQL = {
    "edge_targets": with_(RESPONSES,
        ", p AS (SELECT normalized_url, min(user_id) AS page_id FROM requests GROUP BY 1), f AS (SELECT normalized_url, arg_min(id, sequence) AS id FROM responses "
        "WHERE provenance = 'refetched' GROUP BY 1) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'known' ELSE f.id END AS target_evidence_id, CASE WHEN page_id % 2 <> 0 "
        "AND f.id IS NOT NULL THEN 'refetched' ELSE 'unresolved' END AS disposition FROM p LEFT JOIN f ON f.normalized_url = p.normalized_url"),
    "route_recovery":
        "SELECT 'route-' || page_id AS id, CASE WHEN page_id % 3 = 0 AND page_id % 2 <> 0 THEN 'failed' ELSE 'captured' END AS state, "
        "CASE WHEN page_id % 6 = 0 THEN 'https://r.test/' || page_id || '/final' END AS final_url, CASE WHEN page_id % 6 = 0 THEN 'document-' || page_id END AS document_id "
        "FROM pages",
    "body_parity": with_(RESPONSES, "SELECT normalized_url AS url FROM responses WHERE body_id IS NOT NULL GROUP BY 1 HAVING CAST(regexp_extract(arg_min(request_id, (ts, sequence)), '([0-9]+)$', 1) AS INTEGER) % 7 = 0"),
    "snapshot_parity": with_(RESPONSES, "SELECT sequence AS position FROM exchanges WHERE sequence % 10 = 0 OR sequence % 7 = 0"),
    "entry_documents":
        "SELECT 'https://e.test/' || page_id || '#x' AS page_url, CASE WHEN page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 "
        "AND regexp_matches(html, '<html') THEN 'network-document-v1' ELSE 'live-dom-state-v1' END AS method, CASE WHEN page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 "
        "AND regexp_matches(html, '<html') THEN length(html) ELSE 7 END AS length FROM pages",
    "merged_diagnostics": "SELECT event_type AS code, CAST(user_id % 3 AS VARCHAR) AS reason, sum(event_id % 4) AS count FROM events GROUP BY 1, 2",
    "report_lists": with_(REQUESTS,
        ", f AS (SELECT mission_id AS report, event_type AS type, normalized_url AS item, min(sequence) AS position FROM requests GROUP BY 1, 2, 3) "
        "SELECT report, type, item, position, count(*) OVER (PARTITION BY report, type) > 5 AS truncated FROM f QUALIFY row_number() OVER (PARTITION BY report, type "
        "ORDER BY position) <= 5"),
    "run_stability":
        "WITH r AS (SELECT user_id % 50 AS fixture, event_id AS run, CASE WHEN event_id % 701 = 0 THEN 'odd' ELSE 'even' END AS signature "
        "FROM events), m AS (SELECT *, signature <> first_value(signature) OVER (PARTITION BY fixture ORDER BY run) AS differs FROM r) "
        "SELECT fixture, count(*) AS runs, count(*) FILTER (WHERE differs) AS divergent, min(run % 97) AS min_ms, max(run % 97) AS max_ms, min(run % 89) AS min_size, max(run % 89) AS max_size, count(*) FILTER (WHERE differs) = 0 AS stable "
        "FROM m GROUP BY 1",
    "normal_diagnostics": "SELECT page_id, 'TypeError at (<origin>' || regexp_replace(url, '^https?://[^/]+', '') || ':<line>:<column>)' AS text FROM pages",
    "persisted_bodies": with_(RESPONSES, "SELECT count(*) AS bodies, sum(size) AS bytes, max(size) AS peak FROM (SELECT DISTINCT body_id, size FROM responses WHERE body_id IS NOT NULL)"),
    "latest_routes": "SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS state, arg_max('error-' || event_id, event_id) FILTER (WHERE event_type = 'error') AS reason FROM events GROUP BY 1",
    "source_maps": "SELECT CAST(page_id AS VARCHAR) AS owner, CASE WHEN page_id % 3 = 1 THEN 'https://m.test/maps/' || page_id || '.map' ELSE 'https://m.test/js/' || page_id || '.map' END AS url FROM pages WHERE page_id % 3 <> 0",
    "import_maps": "SELECT CAST(page_id AS VARCHAR) AS owner, 'https://m.test/p/a' || page_id || '.js' AS url FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 'https://m.test/b.js' FROM pages",
    "gltf_files": "SELECT CAST(page_id AS VARCHAR) AS owner, 'https://m.test/g/b' || page_id || '.bin' AS url FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'https://m.test/i.png' FROM pages WHERE page_id % 5 <> 0",
    "hydration":
        "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<body>' || "
        "CASE WHEN page_id % 2 = 0 THEN '<script>self.$R=1</script>' ELSE '' END || '<script type=\"module\" src=\"/m.js\"></script></body>' ELSE '<body><p>' || "
        "CASE WHEN page_id % 2 = 0 THEN '<script>self.$R=1</script>' ELSE '' END || '</BODY>' END AS html FROM pages",
    "form_snapshots":
        "SELECT page_id AS id, '{\"redactedFields\":' || (page_id % 3) || ',\"password\":\"[REDACTED]\"}' AS json, CASE WHEN page_id % 3 > 0 THEN 2 ELSE 1 END AS found, "
        "CASE WHEN page_id % 3 > 0 THEN '<redacted:' || (page_id % 3) || ' fields>' END AS masked FROM pages",
    "child_targets":
        "SELECT page_id % 20 AS mission_id, 'target-' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'iframe' ELSE 'worker' END AS target_type, 's-' || page_id AS session_id, "
        "CASE WHEN page_id % 4 > 0 THEN url ELSE '' END AS original_url, "
        "CASE WHEN page_id % 10 <> 9 THEN 'root-' || (page_id % 20) END AS parent_target_id, 'observed' AS provenance FROM pages",
    "cache_exchanges":
        f"SELECT 'exchange-' || k AS exchange_id, 'request-' || k AS request_id, 'response-' || k AS response_id, 'GET' AS method, {normal('url')} AS normalized_url, 200 + page_id % 4 * 50 AS status, 'sha256:' || sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size, 'CacheStorage' AS resource_type, 'browser-cache' AS classification "
        f"FROM (SELECT *, (page_id % 5) || '-' || page_id AS k FROM pages) WHERE page_id % 9 <> 0 AND page_id % 4 < 2",
    "header_maps": with_(REQUESTS, "SELECT event_id, original_url AS referer, coalesce(request_body, '') AS posted, content_type AS type, 3 AS names FROM requests"),
    "state_fingerprints":
        "SELECT page_id, CAST(list_reduce(list_prepend(5381::BIGINT, [ord(c)::BIGINT FOR c IN string_split(substr(regexp_replace(html, '[^\\x00-\\x7F]', '', 'g'), 1, 200), '')]), lambda h, c: xor((h * 33) & 4294967295, c)) AS VARCHAR) AS fingerprint "
        "FROM pages",
    "runtime_texts":
        "SELECT page_id, sha256(replace(replace(replace(replace(replace(html || chr(39), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS escaped, '{\"a\":\"\\u003c/script>\\u0060\",\"page_id\":' || page_id || '}' AS json, false AS open "
        "FROM pages",
    "shown_sizes":
        "WITH n AS (SELECT page_id, strlen(html) * [0, 1, 300, 300000, 300000000][page_id % 5 + 1] AS n FROM pages), u AS (SELECT page_id, n, "
        "CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k "
        "FROM n), t AS (SELECT *, (n * 20 + CAST(pow(1024, k) AS BIGINT)) // (2 * CAST(pow(1024, k) AS BIGINT)) AS tenths FROM u) SELECT page_id, "
        "CASE WHEN k = 0 THEN n || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS shown FROM t",
    "pending_work": "SELECT page_id, 'page' AS kind FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0",
    "fetchable_references":
        f"SELECT CAST(page_id AS VARCHAR) AS owner, 0 AS n, {origin('url')} || "
        f"CASE WHEN len(string_split({pathname('url')}, '/')) > 3 THEN array_to_string(string_split({pathname('url')}, '/')[1:len(string_split({pathname('url')}, '/')) - 2], '/') || '/' ELSE '/' END || 'i.png' AS resolved_url "
        f"FROM pages",
}
