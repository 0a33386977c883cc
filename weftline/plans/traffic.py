"""Queries over URLs, media types, replay and streams of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media, paths, urls
from ..operators import replay
from ..sources import capture
from . import views
from .views import RESPONSES, normal, origin, path_key, pathname, search, with_

SPLIT = "2024-01-16 00:00:00"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return capture.table(spark, sf, "pages")


def normalized_urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf).select("page_id", urls.normalized(url).alias("normalized_url"), urls.is_http(url).alias("is_http"), urls.origin(url).alias("origin"), urls.fragment(url).alias("fragment"))


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' URLs in capitals, with default ports and dot segments planted; every ninth is no URL."""
    url = F.col("url")
    odd = F.concat(F.upper(urls.origin(url)), F.when(F.startswith(url, F.lit("https:")), ":443").otherwise(":80"), F.lit("/x/./.."), urls.resource_key(url), F.lit("#f"))
    return _pages(spark, sf).select("page_id", urls.canonical(F.when(F.col("page_id") % 9 == 0, "no url").otherwise(odd)).alias("canonical_url"))


def path_keys(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf).select("page_id", urls.path_key(url).alias("path_key"), urls.validation_key(url).alias("validation_key"), urls.resource_key(url).alias("resource_key"), urls.route_key(url, F.when(F.col("page_id") % 2 == 0, "document").otherwise("history")).alias("route_key"))


def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    a = capture.anchors(spark, sf)
    return a.select("page_id", "position", urls.reference_kind(F.col("href")).alias("kind"), urls.resolved(F.col("href"), F.col("base_url")).alias("resolved_url"))


def same_origin_links(spark: SparkSession, sf: str) -> DataFrame:
    a = capture.anchors(spark, sf).withColumn("target", urls.normalized(urls.resolved(F.col("href"), F.col("base_url"))))
    return a.where(urls.is_http(F.col("target")) & (urls.origin(F.col("target")) == urls.origin(F.col("base_url")))).select("page_id", "target").distinct()


def short_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", paths.short_hash(F.col("url")).alias("hash"))


def body_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return capture.page_bodies(spark, sf)


_MIMES = ("text/html; charset=utf-8", "Application/JSON", "image/svg+xml", "model/gltf+json", "video/mp4", "font/woff2", "application/x-javascript", "")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a type and an ending by page_id, so that every class occurs."""
    mime = F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("page_id") % len(_MIMES) + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(t) for t in ("", ".gltf", ".map", ".png?x", ".js")]), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, sf).select("page_id", F.concat(urls.origin(F.col("url")), F.lit("/f/"), F.col("page_id"), tail).alias("url"), mime.alias("mime_type"), F.octet_length("html").cast("long").alias("size"))


_TYPED_SQL = f"t AS (SELECT page_id, {origin('url')} || '/f/' || page_id || ['', '.gltf', '.map', '.png?x', '.js'][page_id % 5 + 1] AS url, {list(_MIMES)}[page_id % {len(_MIMES)} + 1] AS mime_type, CAST(strlen(html) AS BIGINT) AS size FROM pages)"
_KIND = "lower(trim(split_part(mime_type, ';', 1)))"


def mime_class(spark: SparkSession, sf: str) -> DataFrame:
    url, mime = F.col("url"), F.col("mime_type")
    return _typed(spark, sf).select("page_id", media.normalized_type(mime).alias("type"), media.is_catalog_text(url, mime).alias("catalog_text"), media.is_optimizer_text(mime).alias("optimizer_text"), (media.is_gltf_url(url) | F.rlike(F.lower(mime), F.lit(r"model/gltf\+json"))).alias("gltf"), media.is_source_map(url, mime).alias("source_map"), media.is_large_media(mime, F.col("size"), 5000).alias("large_media"), media.extension(mime).alias("extension"))


def eligible_responses(spark: SparkSession, sf: str) -> DataFrame:
    home = F.when(F.col("page_id") % 3 == 0, urls.origin(F.col("url"))).otherwise("https://elsewhere.test")
    kind = F.when(F.col("page_id") % 2 == 0, "Document").otherwise("Image")
    keep = media.should_capture(F.col("url"), F.col("mime_type"), kind, home, urls.origin(F.col("url")))
    return _typed(spark, sf).where(keep).select("page_id", "url", "mime_type")


def tracker_filter(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of which some have a tracker's name planted in the host."""
    planted = F.element_at(F.array(*[F.lit(x) for x in ("cdn.example", "www.Google-Analytics.test", "mc.yandex.test", "app.sentry.test")]), (F.col("page_id") % 4 + 1).cast("int"))
    return _pages(spark, sf).select("page_id", F.concat(F.lit("https://"), planted, urls.pathname(F.col("url"))).alias("url")).where(media.is_tracker(F.col("url")))


def archive_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return p.select("page_id", paths.archive_path(F.col("url"), F.lit("text/html")).alias("archive_path"), paths.snapshot_path(F.concat(F.lit("exchange-"), "page_id"), F.col("page_id"), F.lit(0), F.when(F.col("page_id") % 2 == 0, "application/json").otherwise("text/plain")).alias("snapshot_path"))


def request_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What is retried and which requests send credentials."""
    r = capture.responses(spark, sf)
    home = F.when(F.col("event_id") % 2 == 0, urls.origin(F.col("normalized_url"))).otherwise("https://elsewhere.test")
    return r.select("id", media.is_retried(F.col("status")).alias("retried"), media.credentials(urls.origin(F.col("normalized_url")), home).alias("credentials"))


def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).withColumn("encoded", F.base64(F.col("html").cast("binary")))
    return p.select("page_id", media.body_size(F.col("html"), F.lit(False)).alias("plain_size"), media.body_size(F.regexp_replace("encoded", r"\s", ""), F.lit(True)).alias("decoded_size"), media.format_bytes(F.octet_length("html") * 300).alias("shown"))


def _headers() -> Column:
    e = F.col("event_id")
    return F.map_concat(
        F.when(F.col("content_type") != "", F.create_map(F.lit("Content-Type"), F.when(e % 5 == 0, "text/xml").otherwise(F.concat("content_type", F.lit("; charset=utf-8"))))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(e % 19 == 0, F.create_map(F.lit("Upgrade"), F.lit("WebSocket"))).when(e % 17 == 0, F.create_map(F.lit("ACCEPT"), F.lit("text/event-stream"))).when(e % 13 == 0, F.create_map(F.lit("range"), F.lit("bytes=0-1"))).otherwise(F.create_map().cast("map<string,string>")),
    )


def unsupported_reasons(spark: SparkSession, sf: str) -> DataFrame:
    q = capture.requests(spark, sf).withColumn("headers", _headers())
    url = F.when(F.col("event_id") % 31 == 0, F.lit("ftp://h/x")).when(F.col("event_id") % 29 == 0, F.lit("no url")).otherwise(F.col("normalized_url"))
    reason = replay.unsupported_reason(url, F.col("method"), F.col("headers"), destination=F.when(F.col("event_id") % 11 == 0, "beacon").otherwise(""))
    return q.select("id", reason.alias("reason"))


def _replayed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    recorded = capture.exchanges(spark, sf).where(F.col("ts") < F.lit(SPLIT).cast("timestamp")).select("exchange_id", "sequence", "method", F.col("normalized_url").alias("url"), "content_type", F.col("request_body_hash").alias("body_hash"))
    asked = capture.requests(spark, sf).where((F.col("ts") >= F.lit(SPLIT).cast("timestamp")) & (F.col("event_type") != "view")).select(F.col("id").alias("request_id"), F.struct("ts", "event_id").alias("position"), F.col("user_id").cast("string").alias("client"), "method", F.col("normalized_url").alias("url"), "content_type", F.col("request_body_hash").alias("body_hash"), F.when(F.col("method").isin("GET", "HEAD", "POST"), "").otherwise("unknown-mutation").alias("unsupported"))
    return asked, recorded


def replay_match(spark: SparkSession, sf: str) -> DataFrame:
    return replay.match_in_order(*_replayed(spark, sf))


def replay_match_per_client(spark: SparkSession, sf: str) -> DataFrame:
    return replay.match_in_order(*_replayed(spark, sf), client="client")


def replay_match_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """The general form; every third client asks the runtime's own origin for the paths that it recorded elsewhere."""
    asked, recorded = _replayed(spark, sf)
    asked = asked.withColumn("url", F.when(F.col("client").cast("long") % 3 == 0, F.concat(F.lit("https://runtime.test"), urls.resource_key(F.col("url")))).otherwise(F.col("url")))
    return replay.match_by_path(asked, recorded, "https://runtime.test")


def _slashed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Requests and recordings as above, with a slash behind the path of every second recording and every fifth request."""
    asked, recorded = _replayed(spark, sf)
    slashed = lambda url: F.when(~F.contains(url, F.lit("?")), F.concat(F.regexp_replace(url, "/$", ""), F.lit("/"))).otherwise(url)
    recorded = recorded.withColumn("url", F.when(F.col("sequence") % 2 == 0, slashed(F.col("url"))).otherwise(F.col("url")))
    asked = asked.withColumn("url", F.when(F.col("position.event_id") % 5 == 0, slashed(F.col("url"))).otherwise(F.col("url")))
    away = F.concat(F.lit("https://runtime.test"), urls.resource_key(F.col("url")))
    return asked.withColumn("url", F.when(F.col("client").cast("long") % 3 == 0, away).otherwise(F.col("url"))), recorded


def replay_match_walked(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of one origin have two URLs, between which requests to the runtime choose in order."""
    return replay.match_by_path(*_slashed(spark, sf), "https://runtime.test")


def replay_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Every exchange answered by its own origin and, for every third page, by a mirror of the same path."""
    x = capture.exchanges(spark, sf).select("exchange_id", "method", F.col("normalized_url").alias("url"), "content_type", F.coalesce("request_body_hash", F.lit(paths.EMPTY_HASH)).alias("request_body_hash"), "user_id", "sequence")
    mirror = x.where("user_id % 3 = 0").withColumn("url", F.concat(F.lit("https://mirror.test"), urls.resource_key(F.col("url"))))
    return replay.ambiguity(x.unionByName(mirror))


def replay_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from .graph import replay_misses

    x = capture.exchanges(spark, sf).select("exchange_id", F.col("body_id").isNotNull().alias("body_available"), "status")
    return replay.coverage(x, replay_misses(spark, sf), replay_ambiguity(spark, sf))


def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's network activity: six hours without an event end one."""
    gap = F.session_window("ts", "6 hours")
    s = capture.table(spark, sf, "events").groupBy("user_id", gap.alias("burst")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    return s.select("user_id", F.col("burst.start").alias("started"), "last_ts", "events")


def late_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that come after their mission's evidence was closed count for nothing: per mission, held and dropped.

    A body arrives event_id % 50 minutes after its response; a mission closes two days before its last event.
    """
    r = capture.responses(spark, sf).where("body_state = 'stored'").withColumn("arrived", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 50).cast("int")))
    closing = capture.requests(spark, sf).groupBy("mission_id").agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("closed"))
    return r.join(closing, "mission_id").groupBy("mission_id").agg(F.count_if(F.col("arrived") <= F.col("closed")).alias("held"), F.count_if(F.col("arrived") > F.col("closed")).alias("dropped"))


def repeated_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's actions without those that repeat the one before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return capture.table(spark, sf, "events").withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("actions"))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Displayed progress never falls: the running maximum of a user's values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return capture.table(spark, sf, "events").select("event_id", "user_id", F.max("value").over(w).alias("shown"))


QUERIES = {f.__name__: f for f in (normalized_urls, canonical_urls, path_keys, resolved_links, same_origin_links, short_hash, body_hashes, mime_class, eligible_responses, tracker_filter, archive_paths, request_policy, byte_sizes, unsupported_reasons, replay_match, replay_match_per_client, replay_match_by_path, replay_match_walked, replay_ambiguity, replay_coverage, idle_sessions, late_bodies, repeated_actions, progress)}


def _match_sql(client: str) -> str:
    part = f"{client}method, normalized_url, content_type, coalesce(request_body_hash, '')"
    return with_(RESPONSES, f""", rec AS (SELECT *, row_number() OVER (PARTITION BY method, normalized_url, content_type, coalesce(request_body_hash, '') ORDER BY sequence, exchange_id) AS r FROM exchanges WHERE ts < TIMESTAMP '{SPLIT}'),
 n AS (SELECT method, normalized_url, content_type, coalesce(request_body_hash, '') AS h, count(*) AS n FROM rec GROUP BY ALL),
 ask AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts, event_id) AS r FROM requests WHERE ts >= TIMESTAMP '{SPLIT}' AND event_type <> 'view' AND method <> 'PUT')
 SELECT a.id AS request_id, x.exchange_id, CASE WHEN n.n IS NULL THEN 'not-found' WHEN a.r > n.n THEN 'repeat-exhausted' ELSE '' END AS reason_code FROM ask a
 LEFT JOIN n ON n.method = a.method AND n.normalized_url = a.normalized_url AND n.content_type = a.content_type AND n.h = coalesce(a.request_body_hash, '')
 LEFT JOIN rec x ON x.method = a.method AND x.normalized_url = a.normalized_url AND x.content_type = a.content_type AND coalesce(x.request_body_hash, '') = coalesce(a.request_body_hash, '') AND x.r = a.r
 UNION ALL SELECT id, NULL, 'unknown-mutation' FROM requests WHERE ts >= TIMESTAMP '{SPLIT}' AND event_type <> 'view' AND method = 'PUT'""")


_ANCHORS = "a0 AS (SELECT page_id, url AS base_url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hs FROM pages), anchors AS (SELECT page_id, base_url, CAST(i - 1 AS INTEGER) AS position, hs[i] AS href FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM a0))"
_RESOLVED = f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(base_url, '^([a-z]+:)', 1) || href WHEN href LIKE '/%' THEN {origin('base_url')} || href WHEN href LIKE '?%' THEN {origin('base_url')} || {pathname('base_url')} || href WHEN href LIKE '#%' THEN {normal('base_url')} || href END"
_ENCODED = "array_to_string([CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END FOR c IN string_split({0}, '')], '')"
_TRACKERS = "|".join(media.TRACKERS)
_URL31 = "CASE WHEN event_id % 31 = 0 THEN 'unsupported-url-scheme' WHEN event_id % 29 = 0 THEN 'invalid-request-url' WHEN event_id % 19 = 0 THEN 'websocket' WHEN event_id % 17 = 0 THEN 'sse' WHEN event_id % 13 = 0 THEN 'range-request' WHEN event_id % 11 = 0 THEN 'beacon' WHEN method = 'PUT' THEN 'unknown-mutation' WHEN method = 'POST' AND event_id % 5 = 0 THEN 'unsupported-post-content-type' ELSE '' END"
_SEG = "[CASE WHEN s = '' THEN '_' ELSE regexp_replace(s, '[<>:\"\\\\|?*]', '_', 'g') END FOR s IN [url_decode(x) FOR x IN string_split({0}, '/') IF x <> '']]"

_MIRRORED = f", x AS (SELECT method, normalized_url AS url, content_type, coalesce(request_body_hash, '{paths.EMPTY_HASH}') AS request_body_hash, user_id FROM exchanges), e AS (SELECT method, url, content_type, request_body_hash FROM x UNION ALL SELECT method, 'https://mirror.test' || {pathname('url')} || {search('url')}, content_type, request_body_hash FROM x WHERE user_id % 3 = 0)"

ORACLE_SQL = {
    "normalized_urls": f"SELECT page_id, {normal('url')} AS normalized_url, regexp_matches(lower(url), '^https?://.') AS is_http, {origin('url')} AS origin, regexp_extract(url, '(#.+)$', 1) AS fragment FROM pages",
    "canonical_urls": f"SELECT page_id, CASE WHEN page_id % 9 > 0 THEN {origin('url')} || {pathname('url')} || {search('url')} END AS canonical_url FROM pages",
    "path_keys":
        f"SELECT page_id, {path_key('url')} AS path_key, {path_key('url')} || regexp_extract(url, '(#.+)$', 1) AS validation_key, {pathname('url')} || {search('url')} AS resource_key, "
        f"CASE WHEN page_id % 2 = 0 THEN 'document:' || {normal('url')} ELSE 'history:' || url END AS route_key FROM pages",
    "resolved_links": f"WITH {_ANCHORS} SELECT page_id, position, CASE WHEN href LIKE '#%' THEN 'fragment' ELSE 'network' END AS kind, {_ENCODED.format(_RESOLVED)} AS resolved_url FROM anchors",
    "same_origin_links":
        f"WITH {_ANCHORS}, t AS (SELECT page_id, base_url, regexp_replace({_ENCODED.format(_RESOLVED)}, '#.*$', '') AS target FROM anchors) SELECT DISTINCT page_id, target FROM t "
        f"WHERE target LIKE 'http%' AND {origin('target')} = {origin('base_url')}",
    "short_hash": f"SELECT page_id, {views.SHORT_HASH.format('url')} AS hash FROM pages",
    "body_hashes": "SELECT page_id, 'sha256:' || sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size FROM pages",
    "mime_class":
        f"WITH {_TYPED_SQL} "
        f"SELECT page_id, {_KIND} AS type, mime_type LIKE 'text/%' OR regexp_matches(lower(mime_type), '(java|ecma)script|json|xml|gltf\\+json') OR regexp_matches(url, '\\.gltf($|[?#])') AS catalog_text, {_KIND} LIKE 'text/%' OR regexp_matches({_KIND}, '(java|ecma)script|json|xml|svg|gltf') AS optimizer_text, regexp_matches(url, '\\.gltf($|[?#])') OR contains(lower(mime_type), 'model/gltf+json') AS gltf, regexp_matches(url, '\\.map($|[?#])') AS source_map, regexp_matches({_KIND}, '^(audio|video)/') "
        f"AND size >= 5000 AS large_media, {views.EXTENSION.format(_KIND)} AS extension FROM t",
    "eligible_responses": f"WITH {_TYPED_SQL} SELECT page_id, url, mime_type FROM t WHERE NOT (page_id % 2 = 0 AND page_id % 3 <> 0) AND (mime_type <> '' OR regexp_matches(url, '\\.(gltf|png|js)($|[?#])'))",
    "tracker_filter":
        f"WITH t AS (SELECT page_id, 'https://' || ['cdn.example', 'www.Google-Analytics.test', 'mc.yandex.test', 'app.sentry.test'][page_id % 4 + 1] || {pathname('url')} AS url "
        f"FROM pages) SELECT page_id, url FROM t WHERE regexp_matches(lower(url), '{_TRACKERS}')",
    "archive_paths": f"WITH s AS (SELECT page_id, url, {_SEG.format(pathname('url'))} AS seg, {search('url')} AS search FROM pages), n AS (SELECT *, CASE WHEN len(seg) = 0 THEN 'index' ELSE seg[-1] END AS name, CASE WHEN len(seg) > 1 THEN seg[1:len(seg) - 1] ELSE [] END AS dirs FROM s), m AS (SELECT *, CASE WHEN regexp_matches(lower(name), '\\.[a-z0-9]{{1,10}}$') THEN name ELSE name || '.html' END AS fname FROM n), h AS (SELECT *, {views.SHORT_HASH.format("CASE WHEN search = '' THEN '?' ELSE search END")} AS mark FROM m) SELECT page_id, array_to_string(list_concat(['assets', regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)], dirs, [CASE WHEN search = '' THEN fname WHEN regexp_matches(fname, '^.+\\.[^.]*$') THEN regexp_extract(fname, '^(.+)\\.[^.]*$', 1) || '.' || mark || regexp_extract(fname, '(\\.[^.]*)$', 1) ELSE fname || '.' || mark END]), '/') AS archive_path, 'api-snapshots/' || {views.SHORT_HASH.format(chr(39) + 'exchange-' + chr(39) + ' || page_id || chr(10) || page_id || chr(10) || ' + chr(39) + '0' + chr(39))} || CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '.bin' END AS snapshot_path FROM h",
    "request_policy": with_(RESPONSES, "SELECT id, status IN (408, 425, 429, 500, 502, 503, 504) AS retried, CASE WHEN event_id % 2 = 0 THEN 'include' ELSE 'omit' END AS credentials FROM responses"),
    "byte_sizes":
        "SELECT page_id, CAST(strlen(html) AS BIGINT) AS plain_size, CAST(strlen(html) AS BIGINT) AS decoded_size, "
        "CASE WHEN strlen(html) * 300 < 1024 THEN (strlen(html) * 300) || ' B' WHEN strlen(html) * 300 < 1048576 THEN ((strlen(html) * 6000 + 1024) // 2048 // 10) || '.' || ((strlen(html) * 6000 + 1024) // 2048 % 10) || ' KB' ELSE ((strlen(html) * 6000 + 1048576) // 2097152 // 10) || '.' || ((strlen(html) * 6000 + 1048576) // 2097152 % 10) || ' MB' END AS shown "
        "FROM pages",
    "unsupported_reasons": with_(views.REQUESTS, f"SELECT id, {_URL31} AS reason FROM requests"),
    "replay_match": _match_sql(""),
    "replay_match_per_client": _match_sql("user_id, "),
    "replay_match_by_path": with_(RESPONSES, f""", rec AS (SELECT *, coalesce(request_body_hash, '') AS h, row_number() OVER (PARTITION BY method, normalized_url, content_type, coalesce(request_body_hash, '') ORDER BY sequence, exchange_id) AS r FROM exchanges WHERE ts < TIMESTAMP '{SPLIT}'),
 n AS (SELECT method, normalized_url, content_type, h, count(*) AS n FROM rec GROUP BY ALL),
 by_path AS (SELECT method, {path_key('normalized_url')} AS pk, content_type, h, count(DISTINCT {origin('normalized_url')}) AS origins, count(DISTINCT normalized_url) AS n_urls, min(normalized_url) AS only_url FROM rec GROUP BY ALL),
 q AS (SELECT *, coalesce(request_body_hash, '') AS h, {path_key('normalized_url')} AS pk, user_id % 3 = 0 AS runtime FROM requests WHERE ts >= TIMESTAMP '{SPLIT}' AND event_type <> 'view' AND method <> 'PUT'),
 m AS (SELECT q.* EXCLUDE (normalized_url), runtime AND coalesce(origins, 0) > 1 AS unsure, CASE WHEN NOT runtime THEN normalized_url WHEN n_urls = 1 THEN only_url ELSE 'https://runtime.test' || q.pk END AS url FROM q LEFT JOIN by_path b ON b.method = q.method AND b.pk = q.pk AND b.content_type = q.content_type AND b.h = q.h),
 ask AS (SELECT *, row_number() OVER (PARTITION BY user_id, method, url, content_type, h ORDER BY ts, event_id) AS r FROM m WHERE NOT unsure)
 SELECT a.id AS request_id, x.exchange_id, CASE WHEN n.n IS NULL THEN 'not-found' WHEN a.r > n.n THEN 'repeat-exhausted' ELSE '' END AS reason_code FROM ask a
 LEFT JOIN n ON n.method = a.method AND n.normalized_url = a.url AND n.content_type = a.content_type AND n.h = a.h
 LEFT JOIN rec x ON x.method = a.method AND x.normalized_url = a.url AND x.content_type = a.content_type AND x.h = a.h AND x.r = a.r
 UNION ALL SELECT id, NULL, 'ambiguous' FROM m WHERE unsure
 UNION ALL SELECT id, NULL, 'unknown-mutation' FROM requests WHERE ts >= TIMESTAMP '{SPLIT}' AND event_type <> 'view' AND method = 'PUT'"""),
    "replay_ambiguity": with_(RESPONSES,
        f"{_MIRRORED} SELECT method, {path_key('url')} AS path_key, content_type, request_body_hash, count(DISTINCT {origin('url')}) AS origins, count(*) AS candidates FROM e "
        f"GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT {origin('url')}) > 1"),
    "replay_coverage": with_(RESPONSES,
        f"{_MIRRORED}, amb AS (SELECT 1 FROM e GROUP BY method, {path_key('url')}, content_type, request_body_hash "
        f"HAVING count(DISTINCT {origin('url')}) > 1), a AS (SELECT count(*) AS n FROM amb) "
        f"SELECT count(*) AS recorded, count(*) FILTER (WHERE method <> 'PUT') AS supported, count(*) FILTER (WHERE body_id IS NOT NULL) AS locally_fulfillable, CAST(((2000 * count(*) FILTER (WHERE method <> 'PUT') + count(*)) // (2 * count(*))) / 10.0 AS DOUBLE) AS coverage, any_value(a.n) AS ambiguities, 'ambiguous=' || any_value(a.n) || ',unknown-mutation=' || count(*) FILTER (WHERE method = 'PUT') AS misses "
        f"FROM exchanges, a"),
    "idle_sessions":
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS begins "
        "FROM events), s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g) "
        "SELECT user_id, min(ts) AS started, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, burst",
    "late_bodies": with_(RESPONSES,
        ", c AS (SELECT mission_id, max(ts) - INTERVAL 2 DAYS AS closed FROM requests GROUP BY 1) "
        "SELECT r.mission_id, count(*) FILTER (WHERE ts + to_minutes(event_id % 50) <= closed) AS held, count(*) FILTER (WHERE ts + to_minutes(event_id % 50) > closed) AS dropped "
        "FROM responses r JOIN c ON c.mission_id = r.mission_id WHERE body_state = 'stored' GROUP BY 1"),
    "repeated_actions":
        "WITH b AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS actions "
        "FROM b WHERE before IS NULL OR before <> event_type GROUP BY 1",
    "progress": "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events",
}
