"""Queries over the archive: catalog, crawl decisions, validation, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, urls
from ..operators import body_store, catalog, crawl, planner, storage, validate
from ..sources import archives, capture, zip_files
from ..sources.tables import materialized, shared_folder
from . import views
from .traffic import _SEG
from .views import RESPONSES, origin, path_key, pathname, search, with_


def _resources(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, then their scripts (of equal content for equal page_id % 7 on hosts of page_id % 3), then a source map for every ninth page."""
    p = capture.table(spark, sf, "pages").select("page_id", urls.normalized(F.col("url")).alias("url"), F.col("html"))
    key = F.col("page_id")
    no_route = F.lit(None).cast("string")
    pages = p.select(key.alias("position"), "url", F.lit("text/html").alias("mime_type"), paths.content_hash(F.col("html")).alias("content_hash"), F.octet_length("html").cast("long").alias("size"), (key % 2 == 0).alias("route_page"), F.when(key % 2 == 0, F.concat(F.lit("route-"), F.floor(key / 4))).alias("route_id"))
    text = F.concat(F.lit("body "), key % 7)
    scripts = p.select((key + 1_000_000_000).alias("position"), F.concat(F.lit("https://cdn"), key % 3, F.lit(".test/js/app.js?v="), F.floor(key / 2)).alias("url"), F.when(key % 5 == 0, "font/woff2").otherwise("text/javascript").alias("mime_type"), paths.content_hash(text).alias("content_hash"), F.octet_length(text).cast("long").alias("size"), F.lit(False).alias("route_page"), no_route.alias("route_id"))
    maps = p.where(key % 9 == 0).select((key + 2_000_000_000).alias("position"), F.concat(F.lit("https://cdn0.test/js/"), key, F.lit(".js.map")).alias("url"), F.lit("application/json").alias("mime_type"), paths.content_hash(F.lit("map")).alias("content_hash"), F.lit(3).cast("long").alias("size"), F.lit(False).alias("route_page"), no_route.alias("route_id"))
    return pages.unionByName(scripts).unionByName(maps)


_RESOURCES_SQL = f"""p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, html FROM pages),
res AS (SELECT page_id AS position, url, 'text/html' AS mime_type, 'sha256:' || sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size, page_id % 2 = 0 AS route_page, CASE WHEN page_id % 2 = 0 THEN 'route-' || (page_id // 4) END AS route_id FROM p
 UNION ALL SELECT page_id + 1000000000, 'https://cdn' || (page_id % 3) || '.test/js/app.js?v=' || (page_id // 2), CASE WHEN page_id % 5 = 0 THEN 'font/woff2' ELSE 'text/javascript' END, 'sha256:' || sha256('body ' || (page_id % 7)), 6, false, NULL FROM p
 UNION ALL SELECT page_id + 2000000000, 'https://cdn0.test/js/' || page_id || '.js.map', 'application/json', 'sha256:' || sha256('map'), 3, false, NULL FROM p WHERE page_id % 9 = 0),
j0 AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN route_page THEN 'route:' || route_id ELSE 'url:' || url END ORDER BY position) > 1 OR (NOT route_page AND coalesce(max(CASE WHEN route_page THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS repeated FROM res),
j1 AS (SELECT *, NOT repeated AND regexp_matches(url, '\\.map($|[?#])') AS is_map FROM j0),
j2 AS (SELECT *, CASE WHEN repeated OR is_map OR route_page THEN '' ELSE content_hash || chr(10) || mime_type || chr(10) || CASE WHEN mime_type LIKE 'text/%' THEN {origin('url')} || regexp_extract({pathname('url')}, '^(.*/)', 1) ELSE 'binary' END END AS dedup_key FROM j1),
judged AS (SELECT *, CASE WHEN repeated THEN 'repeated' WHEN is_map THEN 'source-map' WHEN dedup_key <> '' AND row_number() OVER (PARTITION BY dedup_key ORDER BY position) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM j2)"""


def catalog_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.judge(_resources(spark, sf)).select("position", "url", "outcome")


def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_stats(catalog.judge(_resources(spark, sf)))


def catalog_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.aliases(materialized(catalog.judge(_resources(spark, sf)))).select("url", "kept_url")


def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of pages without their query and host, so that many meet."""
    p = capture.table(spark, sf, "pages").select(F.col("page_id").alias("position"), F.concat(F.lit("https://one.test/p"), F.col("page_id") % 11, F.lit(".html?")).alias("url"), F.lit("text/html").alias("mime_type"), F.lit(None).cast("string").alias("content_hash"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("route_page"), F.concat(F.lit("r"), "page_id").alias("route_id"))
    return catalog.catalog(p).select("position", "local_path")


def _numbered_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Pages on one host by the first letters of their own last segment, many with numbers behind them that others' names run into."""
    key = F.col("page_id")
    segment = F.regexp_extract("url", r"([a-z])[a-z0-9]*[^/a-z]*$", 1)
    first, second = F.concat(F.lit("-"), key % 13), F.concat(F.lit("-"), key % 4)
    stem = F.concat(F.lit("https://one.test/"), segment, F.when(key % 3 > 0, first).otherwise(""), F.when(key % 5 == 1, second).otherwise(""), F.lit(".html"))
    no_hash, one = F.lit(None).cast("string").alias("content_hash"), F.lit(1).cast("long").alias("size")
    return capture.table(spark, sf, "pages").select(key.alias("position"), stem.alias("url"), F.lit("text/html").alias("mime_type"), no_hash, one, F.lit(True).alias("route_page"), F.concat(F.lit("r"), "page_id").alias("route_id"))


def archive_names(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog(_numbered_paths(spark, sf)).select("position", "local_path")


def large_media(spark: SparkSession, sf: str) -> DataFrame:
    p = capture.table(spark, sf, "pages").select(F.when(F.col("page_id") % 3 == 0, "video/mp4").otherwise("text/html").alias("mime_type"), (F.octet_length("html") * 10_000).cast("long").alias("size"), F.lit("kept").alias("outcome"))
    return catalog.large_media(p)


def snapshot_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Exchanges with bodies against the pages of even page_id as resources."""
    s = capture.exchanges(spark, sf).where("content_hash is not null").select(F.col("sequence").alias("position"), F.concat(F.lit("api-snapshots/"), "sequence", F.lit(".bin")).alias("local_path"), "content_hash", "size")
    r = capture.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("position"), F.concat(F.lit("assets/"), "page_id", F.lit(".html")).alias("local_path"), paths.content_hash(F.col("html")).alias("content_hash"))
    return catalog.snapshot_bodies(s, r).select("position", "served_from", "written")


def archive_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.estimate(capture.table(spark, sf, "pages").select(F.concat(F.lit("assets/"), "page_id", F.when(F.col("page_id") % 4 == 0, ".png").when(F.col("page_id") % 4 == 1, ".html").otherwise(".bin")).alias("path"), F.when(F.col("page_id") % 4 == 0, "image/png").otherwise("application/octet-stream").alias("mime_type"), F.octet_length("html").cast("long").alias("size")))


def page_route_map(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page_routes(capture.table(spark, sf, "pages").select(F.col("page_id").alias("position"), "url", F.concat(F.lit("/assets/"), "page_id").alias("local_path")))


def resource_route_map(spark: SparkSession, sf: str) -> DataFrame:
    p = capture.table(spark, sf, "pages")
    own = p.select(F.col("page_id").alias("position"), "url", F.concat(F.lit("/assets/"), "page_id").alias("local_path"))
    mirror = p.where("page_id % 3 = 0").select(F.col("page_id").alias("position"), F.concat(F.lit("https://mirror.test"), urls.resource_key(F.col("url"))).alias("url"), F.lit("/assets/mirror").alias("local_path"))
    return catalog.resource_routes(own.unionByName(mirror))


def exclusion_union(spark: SparkSession, sf: str) -> DataFrame:
    judged = materialized(catalog.judge(_resources(spark, sf))).where("outcome = 'source-map'").select(F.lit("source-map").alias("kind"), "url", F.lit("excluded-by-default").alias("reason"), F.col("size").alias("bytes"))
    return catalog.exclusions(judged, judged)


def missing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Archive paths of all pages against those of pages whose id isn't divisible by 9."""
    p = capture.table(spark, sf, "pages").select("page_id", paths.archive_path(F.col("url"), F.lit("text/html")).alias("path"))
    return validate.missing_files(p.select("path", (F.col("page_id") % 2 == 0).alias("critical")).distinct(), p.where("page_id % 9 <> 0")).select("path", "severity")


def script_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with scripts and integrity planted by page_id behind them."""
    key = F.col("page_id")
    extra = F.concat(F.when(key % 3 == 0, '<script src="https://x.test/a.js"></script>').otherwise(""), F.when(key % 4 == 0, "<SCRIPT defer src='/b.js#1'></SCRIPT><script src=\"/b.js\">").otherwise(""), F.when(key % 5 == 0, '<link integrity = "sha256-x">').otherwise(""))
    files = capture.table(spark, sf, "pages").select(F.concat(F.lit("p/"), key, F.when(key % 7 == 0, ".txt").otherwise(".html")).alias("path"), F.concat("html", extra).alias("text"))
    return validate.scan_html(files).select("path", "code", "url")


def _archived(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of sixty archives, each under its own host and path; what is planted in script_scan stands in them too, so archives have files of one path."""
    key = F.col("page_id")
    script = F.concat(F.when(key % 3 == 0, '<script src="/a.js"></script>').otherwise(""), F.when(key % 4 == 0, '<script src="/a.js#x"></script>').otherwise(""), F.when(key % 5 == 0, '<script src="//x.test/b.js"></script>').otherwise(""))
    own = capture.table(spark, sf, "pages").select(F.concat(F.lit("archive-"), key % 60).alias("archive"), F.concat(F.lit("p/"), F.floor(key / 60), F.lit(".html")).alias("path"), F.concat("html", script).alias("text"))
    index = own.select("archive").distinct().select("archive", F.lit("index.html").alias("path"), F.lit('<script src="/a.js"></script>').alias("text"))
    return own.unionByName(index)


def zip_members(spark: SparkSession, sf: str) -> DataFrame:
    """Archives written by many tasks as segments and read back by ranges."""
    folder = shared_folder(spark)
    zip_files.write_zip(_archived(spark, sf).select("archive", "path", F.col("text").cast("binary").alias("bytes")), folder)
    return zip_files.members(spark, folder).select("archive", "path", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


def archive_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """What a validator finds in the pages of sixty archives at once."""
    return validate.scan_html(_archived(spark, sf)).select("archive", "path", "code", "url")


def archive_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each of sixty archives what is missing of what it should have, what its pages load, and the verdict."""
    files = _archived(spark, sf)
    required = files.select("archive").distinct().select("archive", F.explode(F.array(F.lit("index.html"), F.lit("p/0.html"), F.lit("p/3.html"))).alias("path")).withColumn("critical", F.col("path") == "p/3.html")
    missing = validate.missing_files(required, files.where("archive <> 'archive-7' or path <> 'index.html'"))
    quiet = missing.where("false").select("archive", "category", "code", F.lit("info").alias("severity"), "path", "url", "message")
    return validate.finalize(missing.unionByName(validate.scan_html(files)).unionByName(quiet), archives=files.select("archive"))


def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    pages = capture.table(spark, sf, "pages").select("page_id", "url")
    problems = validate.input_diagnostics(unresolved=pages.where("page_id % 10 = 0").select("url", F.lit(None).cast("string").alias("reason")), exclusions=pages.where("page_id % 25 = 0").select(F.col("url").alias("location")), routes=pages.select("url", F.when(F.col("page_id") % 8 == 0, "failed").otherwise("captured").alias("state"), F.lit(None).cast("string").alias("decision_reason")))
    return validate.finalize(problems)


def user_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    status = validate.user_status(F.when(k % 3 == 0, "ready").when(k % 3 == 1, "failed").otherwise("partial"), k % 5, F.lit(3), k % 7, F.lit(4), k % 2)
    return capture.table(spark, sf, "pages").select("page_id", status.alias("status"))


def route_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Crawls of ten pages' links each, with variants (relative ones too) planted by (page_id, position), under small budgets."""
    a = capture.anchors(spark, sf)
    key, n = F.col("page_id"), F.col("position")
    home = F.concat(F.lit("https://site"), F.floor(key / 10), F.lit(".test"))
    url = (
        F.when((key + n) % 13 == 0, F.concat(F.lit("https://other.test"), "href")).when((key + n) % 11 == 0, F.concat(F.lit("#s"), n)).when((key + n) % 17 == 0, "").when((key + n) % 19 == 0, "mailto:a@b.test").otherwise(F.concat(F.element_at(F.array(F.lit("/r"), F.lit("r"), F.lit("./r"), F.lit("/a/../r"), F.lit("../r")), ((key + n) % 5 + 1).cast("int")), (key * 7 + n) % 29))
    )
    c = a.select(F.floor(key / 10).alias("crawl"), F.concat(home, F.lit("/")).alias("seed_url"), F.concat(home, F.lit("/r0")).alias("base_url"), (key * 1000 + n).alias("position"), url.alias("url"), F.when((key + n) % 23 == 0, "area").alias("element_kind"), F.when((key + n) % 31 == 0, "_blank").alias("target"), ((key + n) % 37 == 0).alias("download"), F.lit(False).alias("form_action"))
    return crawl.decide(c, crawl.Policy(max_pages=12, max_candidates=60, max_history_states=2)).select("crawl", "position", "state", "reason")


def crawl_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Crawls of ten pages each, by the links of the pages that are visited; some redirect, name another canonical page or fail."""
    anchors = materialized(capture.anchors(spark, sf).select("page_id", "position", "href"))
    size = materialized(capture.table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes")))
    home = F.concat(F.lit("https://site"), F.col("crawl").cast("string"), F.lit(".test"))

    def visit(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
        number = F.regexp_extract("route_url", r"/r([0-9]+)", 1).cast("long")
        seen = routes.withColumn("k", F.coalesce(number, F.lit(0).cast("long"))).withColumn("page_id", F.col("crawl") * 10 + F.col("k") % 10)
        k = F.col("k")
        page = lambda n: F.concat(home, F.lit("/r"), n.cast("string"))
        results = seen.join(size, "page_id").select(
            "crawl", "n", F.when(k % 7 == 3, page(k + 1)).alias("final_url"), F.when(k % 11 == 5, F.concat(page(k - 1), F.lit("#top"))).alias("canonical_url"), "bytes",
            (F.col("n") * 1000).cast("long").alias("elapsed_ms"), F.when(k % 13 == 6, "navigation-timeout").alias("failed"),
        )
        n = F.col("position")
        url = F.when((k + n) % 17 == 0, F.concat(F.lit("#s"), n)).when((k + n) % 19 == 0, "https://other.test/x").when((k + n) % 23 == 0, "").otherwise(F.concat(F.lit("../r"), (F.col("page_id") * 7 + n) % 29))
        found = seen.join(anchors, "page_id").select("crawl", "position", url.alias("url"), page(k).alias("base_url"), F.lit(None).cast("string").alias("element_kind"), F.when((k + n) % 31 == 0, "_blank").alias("target"), F.lit(False).alias("download"), F.lit(False).alias("form_action"), F.lit(None).cast("string").alias("transition_kind"))
        return results, found

    seeds = size.select(F.floor(F.col("page_id") / 10).alias("crawl")).distinct().withColumn("seed_url", F.concat(home, F.lit("/r0")))
    policy = crawl.Policy(max_pages=6, max_candidates=30, max_history_states=1, max_bytes=60_000, max_duration_ms=25_000)
    return planner.planned(seeds, visit, policy).select("crawl", "n", "route_url", "transition_kind", "state", "reason", "alias_of", "turn")


def crawl_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Ten accepted routes to a crawl; of every ten the third redirects to the fifth, and the seventh says that the second is its canonical form."""
    p = capture.table(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).alias("crawl"), (F.col("page_id") % 10).alias("position"))
    url = lambda n: F.concat(F.lit("https://c.test/"), n.cast("string"))
    accepted = p.select("crawl", "position", url(F.col("position")).alias("route_url"), F.lit("document").alias("transition_kind"))
    results = p.select("crawl", "position", F.when(F.col("position") == 3, url(F.lit(5))).alias("final_url"), F.when(F.col("position") == 7, F.concat(url(F.lit(2)), F.lit("#top"))).alias("canonical_url"))
    return crawl.completed(accepted, results)


def fetch_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """What ten pages' links lead to, every third as a page, beside what is held already; small limits."""
    a = capture.anchors(spark, sf).select(F.floor(F.col("page_id") / 10).alias("capture"), F.concat(F.lit("https://f.test/"), (F.col("page_id") * 5 + F.col("position")) % 41, F.lit("#x")).alias("url"), (F.col("page_id") * 1000 + F.col("position")).alias("position"))
    found = a.withColumn("kind", F.when(F.col("position") % 3 == 0, "page").otherwise("resource"))
    held = a.select("capture", F.lit("https://f.test/7").alias("url"))
    return crawl.frontier(found, held, 15, 3).select("capture", "url", "kind", "position", "queued")


def validation_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of an archive for every hundred, each with a route of its own or none and sometimes an alias; the first page is the root."""
    p = capture.table(spark, sf, "pages").withColumn("archive", F.floor(F.col("page_id") / 100)).withColumn("u", F.concat(F.lit("https://v.test/p"), F.col("page_id") % 97))
    no = F.lit(None).cast("string")
    resources = p.select("archive", F.col("page_id").alias("position"), F.when(F.col("page_id") % 6 == 5, "text/css").otherwise("Text/HTML; charset=x").alias("mime_type"), F.col("u").alias("url"), no.alias("route_url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("route-"), "page_id")).alias("route_id"), F.when(F.col("page_id") % 4 == 0, F.array(F.concat("u", F.lit("/#a")))).alias("aliases"), F.concat(F.lit("/assets/"), "page_id", F.lit(".html")).alias("local_path"))
    roots = p.select("archive").distinct().withColumn("page_url", F.lit("https://v.test/p0"))
    planned = validate.plan_routes(validate.validation_routes(resources, roots), 40)
    return planned.select("archive", "place", "url", "local_path", "over_budget", F.startswith("route_id", F.lit("route-")).alias("own_route"))


def optimization_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = capture.exchanges(spark, sf).where("content_hash is not null").select(F.col("sequence").alias("position"), F.concat(F.lit("api-snapshots/"), "sequence", F.lit(".bin")).alias("local_path"), "content_hash", "size")
    r = capture.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("position"), F.concat(F.lit("assets/"), "page_id", F.lit(".html")).alias("local_path"), paths.content_hash(F.col("html")).alias("content_hash"))
    judged = materialized(catalog.judge(_resources(spark, sf)))
    left = judged.where("outcome = 'source-map'").select(F.lit("source-map").alias("kind"), "url", F.lit("excluded-by-default").alias("reason"), F.col("size").alias("bytes"))
    return catalog.optimization_summary(judged, left.unionByName(left), catalog.snapshot_bodies(s, r))


def deflated_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Page bodies really deflated; what repeats shrinks to a small part."""
    p = capture.table(spark, sf, "pages").select(F.concat(F.lit("assets/"), "page_id").alias("path"), F.repeat(F.lit("ab"), F.lit(5000)).cast("binary").alias("body"), "html")
    return catalog.deflated(p.select("path", F.concat(F.col("html").cast("binary"), F.col("body")).alias("body"))).select("file_count", "physical_bytes", (F.col("estimated_archive_bytes") < F.col("physical_bytes") / 2).alias("halved"), (F.col("estimated_bytes_saved") > 0).alias("saved"))


def hydrated_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which every second holds its body in storage only."""
    p = capture.table(spark, sf, "pages").withColumn("storage_key", F.concat(F.lit("body-"), "page_id"))
    resources = p.select("page_id", "url", F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html").alias("mime_type"), "storage_key", F.when(F.col("page_id") % 2 == 0, F.col("html").cast("binary")).alias("body"))
    bodies = p.where("page_id % 2 = 1 and page_id % 7 <> 0").select("storage_key", F.col("html").cast("binary").alias("body"))
    return storage.hydrated(resources, bodies).select("page_id", F.octet_length("body").cast("long").alias("size"), F.length("text").cast("long").alias("characters"))


def mission_records(spark: SparkSession, sf: str) -> DataFrame:
    """Missions with the bodies of their pages, as persisted."""
    b = capture.table(spark, sf, "pages").select((F.col("page_id") % 20).alias("mission_id"), F.struct(F.col("page_id").alias("id"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("body")).alias("b"))
    m = storage.without_inline_bodies(b.groupBy("mission_id").agg(F.array_sort(F.collect_list("b")).alias("bodies")))
    return m.select("mission_id", F.size("bodies").cast("long").alias("bodies"), F.aggregate("bodies", F.lit(0).cast("long"), lambda t, x: t + x["size"]).alias("size"), F.exists("bodies", lambda x: x["body"].isNotNull()).alias("inline"))


def archive_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of archives of fifty pages each."""
    files = capture.table(spark, sf, "pages").select(F.floor(F.col("page_id") / 50).alias("archive"), F.concat(F.lit("assets/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("bytes"))
    return archives.manifest(files).select("archive", F.sha2("bytes", 256).alias("sha"))


def byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    r = capture.responses(spark, sf).where("size is not null")
    return storage.within_budget(r.select("id", "mission_id", "sequence", "size"), 300_000).select("id", "so_far", "kept")


def crawl_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """From page 1 over the links p -> 2p + 1 and p -> 3p + 2, modulo the number of pages, as deep as its SQL goes."""
    p = capture.table(spark, sf, "pages").select("page_id")
    n = p.count()
    links = p.select(F.col("page_id").cast("string").alias("source"), F.explode(F.array((2 * F.col("page_id") + 1) % n, (3 * F.col("page_id") + 2) % n).cast("array<string>")).alias("target"))
    return crawl.reachable(spark.createDataFrame([("1",)], "url string"), links, most_depth=24)


def body_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Page bodies in chunks of 1000 bytes and put together again: chunks, size and hash of each."""
    p = capture.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("storage_key"), F.col("html").cast("binary").alias("body"))
    chunks = storage.body_chunks(p, 1000)
    whole = storage.read_bodies(chunks, p.select("storage_key", F.ceil(F.octet_length("body") / 1000).cast("int").alias("chunk_count")))
    return whole.select("storage_key", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha"), "complete")


def committed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Writes of document texts; every tenth has a wrong size and is aborted."""
    d = capture.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("write_id"), F.col("doc_id").alias("position"), (F.octet_length("text") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("expected_size"), F.col("text").cast("binary").alias("body"))
    return storage.committed(d).select("write_id", "content_hash", "size", "duplicate")


def orphan_bodies(spark: SparkSession, sf: str) -> DataFrame:
    owners = capture.responses(spark, sf).where("content_hash is not null").select("mission_id", "content_hash").union(capture.responses(spark, sf).where("content_hash is not null and event_id % 50 = 0").select(((F.col("mission_id") + 1) % 20).alias("mission_id"), "content_hash"))
    return storage.orphans(owners, 3)


_STATES = ("starting", "capturing", "finalizing", "building", "complete", "cancelled")


def mission_recovery(spark: SparkSession, sf: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("user_id") % 6 + 1).cast("int"))
    states = capture.requests(spark, sf).select(F.col("user_id").alias("mission_id"), "ts", "sequence", state.alias("state"))
    return storage.recovered(storage.latest_missions(states)).select("mission_id", "state", "recovery", "ts")


def stored_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A store of whole pages and documents after four batches: pages of missions by their id, documents and pages again for others, that batch sent twice, one broken off, and a mission removed."""
    pages = capture.table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("text"))
    documents = capture.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("k")

    def writes(rows: DataFrame, name: str, mission: Column, expected: Column) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{name}-"), k).alias("write_id"), mission.cast("long").alias("mission_id"), k.alias("position"), expected.cast("long").alias("expected_size"), F.lit("text/html").alias("mime_type"), F.col("text").cast("binary").alias("body"))

    size, none = F.octet_length("text"), F.lit(None)
    store = body_store.BodyStore(spark, shared_folder(spark), chunk=4096)
    store.commit(0, writes(pages, "page", k % 5, F.when(k % 11 == 0, size + 1).otherwise(none)))
    second = writes(documents, "document", 5 + k % 3, none).unionByName(writes(pages.where("k % 4 = 0"), "again", F.lit(6), size))
    store.commit(1, second)
    store.commit(1, second)
    store.stage(2, writes(pages, "lost", F.lit(9), none))
    store.remove_mission(2)
    held = store.chunk_rows().groupBy("content_hash").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("bytes")).alias("bytes"))
    owners = store.table("owners").groupBy("content_hash").agg(F.count(F.lit(1)).alias("owners"), F.min("mission_id").alias("first_owner"))
    bodies = store.table("bodies").select("content_hash", "size", "chunk_count", "batch_id")
    return bodies.join(owners, "content_hash", "left").join(held, "content_hash", "left").select("content_hash", "size", "chunk_count", "batch_id", "owners", "first_owner", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def quota_status(spark: SparkSession, sf: str) -> DataFrame:
    d = capture.table(spark, sf, "documents").select("doc_id", storage.quota(F.lit(64 << 20), F.col("doc_id") * 100_000, F.col("n_chars") * 10_000).alias("q"))
    return d.select("doc_id", "q.available", "q.checked", "q.fits")


QUERIES = {f.__name__: f for f in (catalog_outcomes, catalog_stats, catalog_aliases, path_collisions, archive_names, large_media, snapshot_dedup, archive_estimate, page_route_map, resource_route_map, exclusion_union, missing_files, script_scan, zip_members, archive_scripts, archive_verdicts, validation_status, user_status, route_decisions, crawl_rounds, crawl_completed, fetch_frontier, validation_plan, optimization_summary, deflated_archive, hydrated_bodies, mission_records, archive_manifests, byte_budget, crawl_reachable, body_chunks, committed_bodies, orphan_bodies, mission_recovery, stored_bodies, quota_status)}

_PATH_SQL = f"s AS (SELECT page_id, url, {_SEG.format(pathname('url'))} AS seg, {search('url')} AS search FROM pages), n AS (SELECT *, CASE WHEN len(seg) = 0 THEN 'index' ELSE seg[-1] END AS name, CASE WHEN len(seg) > 1 THEN seg[1:len(seg) - 1] ELSE [] END AS dirs FROM s), m AS (SELECT *, CASE WHEN regexp_matches(lower(name), '\\.[a-z0-9]{{1,10}}$') THEN name ELSE name || '.html' END AS fname FROM n), h AS (SELECT *, {views.SHORT_HASH.format("CASE WHEN search = '' THEN '?' ELSE search END")} AS mark FROM m), ap AS (SELECT page_id, array_to_string(list_concat(['assets', regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)], dirs, [CASE WHEN search = '' THEN fname WHEN regexp_matches(fname, '^.+\\.[^.]*$') THEN regexp_extract(fname, '^(.+)\\.[^.]*$', 1) || '.' || mark || regexp_extract(fname, '(\\.[^.]*)$', 1) ELSE fname || '.' || mark END]), '/') AS path FROM h)"
_ANCHOR_SQL = "a0 AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hs FROM pages), anchors AS (SELECT page_id, i - 1 AS n, hs[i] AS href FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM a0))"
_DECIDE_SQL = f"""{_ANCHOR_SQL},
c0 AS (SELECT page_id // 10 AS crawl, page_id * 1000 + n AS position, page_id + n AS k, 'https://site' || (page_id // 10) || '.test' AS home,
 CASE WHEN (page_id + n) % 13 = 0 THEN 'https://other.test' || href WHEN (page_id + n) % 11 = 0 THEN '#s' || n WHEN (page_id + n) % 17 = 0 THEN '' WHEN (page_id + n) % 19 = 0 THEN 'mailto:a@b.test' ELSE '/r' || ((page_id * 7 + n) % 29) END AS url FROM anchors),
c1 AS (SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY position) AS i FROM c0),
c2 AS (SELECT *, CASE WHEN i > 60 THEN 'candidate-budget' WHEN k % 23 = 0 THEN 'not-ordinary-anchor' WHEN k % 37 = 0 THEN 'download-link' WHEN k % 31 = 0 THEN 'non-self-target' WHEN url = '' THEN 'empty-url' WHEN url LIKE 'mailto:%' THEN 'non-http' WHEN url LIKE 'https://other%' THEN 'cross-origin' END AS fixed, url LIKE '#%' AS history, CASE WHEN url LIKE '#%' THEN 'history:' || home || '/r0' || url ELSE 'document:' || home || url END AS key FROM c1 WHERE i <= 61),
o0 AS (SELECT *, row_number() OVER (PARTITION BY crawl, key ORDER BY position) = 1 AS first FROM c2 WHERE fixed IS NULL),
o1 AS (SELECT *, first AND (NOT history OR sum(CASE WHEN first AND history THEN 1 ELSE 0 END) OVER (PARTITION BY crawl ORDER BY position ROWS UNBOUNDED PRECEDING) <= 2) AS eligible FROM o0),
o2 AS (SELECT *, eligible AND sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (PARTITION BY crawl ORDER BY position ROWS UNBOUNDED PRECEDING) <= 12 AS accepted FROM o1),
o3 AS (SELECT *, coalesce(max(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY crawl, key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS taken, coalesce(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY crawl ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o2)
SELECT crawl, position, CASE WHEN accepted THEN 'accepted' ELSE 'skipped' END AS state, CASE WHEN accepted THEN 'same-origin-anchor' WHEN taken THEN 'duplicate-route' WHEN before >= 12 THEN 'page-budget' ELSE 'state-budget' END AS reason FROM o3
UNION ALL SELECT crawl, position, 'skipped', fixed FROM c2 WHERE fixed IS NOT NULL"""

_ARCHIVED_SQL = """a AS (SELECT 'archive-' || (page_id % 60) AS archive, 'p/' || (page_id // 60) || '.html' AS path, html || CASE WHEN page_id % 3 = 0 THEN '<script src="/a.js"></script>' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '<script src="/a.js#x"></script>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<script src="//x.test/b.js"></script>' ELSE '' END AS text FROM pages
 UNION ALL SELECT DISTINCT 'archive-' || (page_id % 60), 'index.html', '<script src="/a.js"></script>' FROM pages),
tags AS (SELECT archive, path, n, trim(regexp_extract(tag, '(?i)\\bsrc\\s*=\\s*["'']([^"'']+)["'']', 1)) AS src FROM (SELECT archive, path, unnest(t) AS tag, unnest(range(1, len(t) + 1)) AS n FROM (SELECT archive, path, regexp_extract_all(text, '(?i)<script\\b([^>]*)>', 1) AS t FROM a))),
scan AS (SELECT archive, path, 'stale-subresource-integrity' AS code, NULL AS url FROM a WHERE regexp_matches(text, '(?i)\\bintegrity\\s*=\\s*["''][^"'']+["'']')
 UNION ALL SELECT archive, path, 'external-executable-reference', src FROM tags WHERE src <> '' AND regexp_matches(src, '(?i)^(https?:)?//')
 UNION ALL SELECT archive, path, 'duplicate-executable-reference', src FROM (SELECT *, row_number() OVER (PARTITION BY archive, path, regexp_replace(src, '#.*$', '') ORDER BY n) AS r FROM tags WHERE src <> '') WHERE r > 1)"""

ORACLE_SQL = {
    "stored_bodies": """WITH w AS (SELECT page_id % 5 AS mission, html AS text, 0 AS batch FROM pages WHERE page_id % 11 <> 0 UNION ALL SELECT 5 + doc_id % 3, coalesce(text, ''), 1 FROM documents UNION ALL SELECT 6, html, 1 FROM pages WHERE page_id % 4 = 0),
o AS (SELECT DISTINCT 'sha256:' || sha256(text) AS content_hash, mission FROM w WHERE mission <> 2),
b AS (SELECT 'sha256:' || sha256(text) AS content_hash, max(strlen(text)) AS size, min(batch) AS batch_id FROM w GROUP BY 1)
SELECT b.content_hash, CAST(size AS BIGINT) AS size, CAST(ceil(size / 4096) AS INTEGER) AS chunk_count, batch_id, n.owners, n.first_owner, CAST(ceil(size / 4096) AS BIGINT) AS chunks, CAST(size AS BIGINT) AS bytes
FROM b JOIN (SELECT content_hash, count(*) AS owners, min(mission) AS first_owner FROM o GROUP BY 1) n ON n.content_hash = b.content_hash""",
    "zip_members": f"WITH {_ARCHIVED_SQL} SELECT archive, path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM a",
    "archive_scripts": f"WITH {_ARCHIVED_SQL} SELECT archive, path, code, url FROM scan",
    "archive_verdicts": f"""WITH {_ARCHIVED_SQL}, lost AS (SELECT w.archive, w.path FROM (SELECT DISTINCT archive, unnest(['index.html', 'p/0.html', 'p/3.html']) AS path FROM a) w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.archive = w.archive AND a.path = w.path) OR (w.archive = 'archive-7' AND w.path = 'index.html')),
d AS (SELECT archive, CASE WHEN path = 'p/3.html' THEN 1 ELSE 0 END AS error FROM lost UNION ALL SELECT archive, 0 FROM scan)
SELECT a.archive, CASE WHEN coalesce(max(error), 0) > 0 THEN 'failed' WHEN count(d.archive) > 0 THEN 'partial' ELSE 'ready' END AS status, count(d.archive) AS issue_count, 0 AS info_count, CASE WHEN count(d.archive) > 0 THEN 'rewrite-failure=' || count(d.archive) ELSE '' END AS categories FROM (SELECT DISTINCT archive FROM a) a LEFT JOIN d ON d.archive = a.archive GROUP BY a.archive""",
    "catalog_outcomes": f"WITH {_RESOURCES_SQL} SELECT position, url, outcome FROM judged",
    "catalog_stats":
        f"WITH {_RESOURCES_SQL} "
        f"SELECT sum(size) FILTER (WHERE outcome <> 'repeated') AS logical_bytes, sum(size) FILTER (WHERE outcome = 'kept') AS physical_bytes, coalesce(sum(size) FILTER (WHERE outcome = 'duplicate'), 0) AS deduplicated_bytes, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_bodies, coalesce(sum(size) FILTER (WHERE outcome = 'source-map'), 0) AS excluded_bytes, count(*) FILTER (WHERE outcome = 'kept') AS resources "
        f"FROM judged",
    "catalog_aliases": f"WITH {_RESOURCES_SQL} SELECT d.url, k.url AS kept_url FROM judged d JOIN judged k ON d.dedup_key = k.dedup_key AND k.outcome = 'kept' AND k.dedup_key <> '' WHERE d.outcome = 'duplicate'",
    "archive_names": """WITH RECURSIVE b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i, 'assets/one.test/' || regexp_extract(url, '([a-z])[a-z0-9]*[^/a-z]*$', 1) || CASE WHEN page_id % 3 > 0 THEN '-' || (page_id % 13) ELSE '' END || CASE WHEN page_id % 5 = 1 THEN '-' || (page_id % 4) ELSE '' END AS front FROM pages),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used UNION ALL
 SELECT b.i, list_append(w.used, list_filter(list_transform(range(1, len(w.used) + 3), lambda n: b.front || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.html'), lambda x: NOT list_contains(w.used, x))[1]) FROM w JOIN b ON b.i = w.i + 1)
SELECT b.page_id AS position, w.used[b.i] AS local_path FROM b JOIN w ON w.i = (SELECT max(i) FROM b)""",
    "path_collisions":
        "SELECT page_id AS position, 'assets/one.test/p' || (page_id % 11) || CASE WHEN row_number() OVER (PARTITION BY page_id % 11 "
        "ORDER BY page_id) > 1 THEN '-' || row_number() OVER (PARTITION BY page_id % 11 ORDER BY page_id) ELSE '' END || '.html' AS local_path FROM pages",
    "large_media": "SELECT count(*) AS candidates, coalesce(sum(strlen(html) * 10000), 0) AS bytes FROM pages WHERE page_id % 3 = 0 AND strlen(html) * 10000 >= 26214400",
    "snapshot_dedup": with_(RESPONSES,
        ", r AS (SELECT 'sha256:' || sha256(html) AS content_hash, arg_max('/assets/' || page_id || '.html', page_id) AS path FROM pages WHERE page_id % 2 = 0 "
        "GROUP BY 1), s AS (SELECT x.sequence AS position, x.content_hash, r.path, row_number() OVER w AS n, first_value('api-snapshots/' || x.sequence || '.bin') "
        "OVER w AS first_path FROM exchanges x LEFT JOIN r ON r.content_hash = x.content_hash WHERE x.content_hash IS NOT NULL WINDOW w AS (PARTITION BY x.content_hash "
        "ORDER BY x.sequence)) SELECT position, coalesce(path, first_path) AS served_from, path IS NULL AND n = 1 AS written FROM s"),
    "archive_estimate":
        "WITH f AS (SELECT 'assets/' || page_id || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.html' ELSE '.bin' END AS path, strlen(html) AS size, CASE page_id % 4 WHEN 0 THEN 99 WHEN 1 THEN 52 ELSE 82 END AS ratio "
        "FROM pages) "
        "SELECT count(*) AS file_count, sum(size) AS physical_bytes, sum((size * ratio + 99) // 100) + sum(92 + 2 * strlen(path)) + 22 AS estimated_archive_bytes, greatest(0, sum(size) - sum((size * ratio + 99) // 100)) AS estimated_bytes_saved "
        "FROM f",
    "page_route_map": f"SELECT {path_key('url')} AS path_key, arg_max('/assets/' || page_id, page_id) AS local_path FROM pages WHERE {path_key('url')} <> '/' GROUP BY 1",
    "resource_route_map":
        f"WITH k AS (SELECT {pathname('url')} || {search('url')} AS path_key, {origin('url')} AS origin, page_id, '/assets/' || page_id AS local_path FROM pages), e AS (SELECT * "
        f"FROM k UNION ALL SELECT path_key, 'https://mirror.test', page_id, '/assets/mirror' FROM k WHERE page_id % 3 = 0) "
        f"SELECT path_key, arg_max(local_path, page_id) AS local_path FROM e GROUP BY 1 HAVING count(DISTINCT origin) = 1",
    "exclusion_union": f"WITH {_RESOURCES_SQL} SELECT 'source-map' AS kind, url, 'excluded-by-default' AS reason, min(size) AS bytes FROM judged WHERE outcome = 'source-map' GROUP BY url",
    "missing_files": f"WITH {_PATH_SQL} SELECT DISTINCT path, CASE WHEN page_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM ap WHERE path NOT IN (SELECT path FROM ap WHERE page_id % 9 <> 0)",
    "script_scan": """WITH f AS (SELECT 'p/' || page_id || CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.html' END AS path, html || CASE WHEN page_id % 3 = 0 THEN '<script src="https://x.test/a.js"></script>' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '<SCRIPT defer src=''/b.js#1''></SCRIPT><script src="/b.js">' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<link integrity = "sha256-x">' ELSE '' END AS text FROM pages),
h AS (SELECT path, text, regexp_extract_all(text, '(?i)<script\\b([^>]*)>', 1) AS tags FROM f WHERE path LIKE '%.html'),
s AS (SELECT path, i, trim(regexp_extract(tags[i], '(?i)\\bsrc\\s*=\\s*["'']([^"'']+)["'']', 1)) AS src FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM h))
SELECT path, 'stale-subresource-integrity' AS code, NULL AS url FROM h WHERE regexp_matches(text, '(?i)\\bintegrity\\s*=\\s*["''][^"'']+["'']')
UNION ALL SELECT path, 'external-executable-reference', src FROM s WHERE regexp_matches(src, '(?i)^(https?:)?//')
UNION ALL (SELECT path, 'duplicate-executable-reference', src FROM s WHERE src <> '' QUALIFY row_number() OVER (PARTITION BY path, regexp_replace(src, '#.*$', '') ORDER BY i) > 1)""",
    "crawl_completed":
        "SELECT page_id // 10 AS crawl, page_id % 10 AS position, CASE WHEN page_id % 10 IN (2, 5) "
        "AND page_id // 10 * 10 + CASE page_id % 10 WHEN 2 THEN 7 ELSE 3 END < (SELECT count(*) "
        "FROM pages) THEN 'skipped' ELSE 'captured' END AS state, CASE page_id % 10 WHEN 2 THEN 'canonical-alias' WHEN 5 THEN 'redirect-alias' ELSE 'rendered-captured' END AS reason, CASE page_id % 10 WHEN 2 THEN 7 WHEN 5 THEN 3 END AS alias_of "
        "FROM pages",
    "fetch_frontier": f"""WITH {_ANCHOR_SQL}, u AS (SELECT page_id // 10 AS capture, 'https://f.test/' || ((page_id * 5 + n) % 41) AS url, page_id * 1000 + n AS position FROM anchors),
f AS (SELECT capture, url, min(position) AS position FROM u WHERE url <> 'https://f.test/7' GROUP BY 1, 2), k AS (SELECT *, CASE WHEN position % 3 = 0 THEN 'page' ELSE 'resource' END AS kind FROM f),
g AS (SELECT *, kind <> 'page' OR sum(CASE WHEN kind = 'page' THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY position ROWS UNBOUNDED PRECEDING) <= 3 AS fits FROM k)
SELECT capture, url, kind, position, fits AND sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY position ROWS UNBOUNDED PRECEDING) <= 15 AS queued FROM g""",
    "validation_plan": """WITH p AS (SELECT page_id // 100 AS archive, page_id, '/p' || (page_id % 97) AS k FROM pages WHERE page_id % 6 <> 5),
c AS (SELECT archive, page_id, 0 AS n, k AS key, 'https://v.test' || k AS url FROM p UNION ALL SELECT archive, page_id, 2, k || '#a', 'https://v.test' || k || '/#a' FROM p WHERE page_id % 4 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY archive, key ORDER BY page_id, n) AS r FROM c WHERE key <> '/p0'),
o AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY page_id, n) AS place, row_number() OVER (PARTITION BY archive, page_id ORDER BY n) AS lead FROM f WHERE r = 1)
SELECT archive, CAST(place AS INTEGER) AS place, url, 'assets/' || page_id || '.html' AS local_path, place > 40 AS over_budget, lead = 1 AND page_id % 2 = 0 AS own_route FROM o""",
    "optimization_summary": with_(RESPONSES, f""", {_RESOURCES_SQL}, r AS (SELECT DISTINCT 'sha256:' || sha256(html) AS content_hash FROM pages WHERE page_id % 2 = 0),
 s AS (SELECT x.size, r.content_hash IS NULL AND row_number() OVER (PARTITION BY x.content_hash ORDER BY x.sequence) = 1 AS written FROM exchanges x LEFT JOIN r ON r.content_hash = x.content_hash WHERE x.content_hash IS NOT NULL),
 a AS (SELECT sum(size) AS l, coalesce(sum(size) FILTER (WHERE written), 0) AS w, count(*) FILTER (WHERE NOT written) AS d FROM s),
 j AS (SELECT sum(size) FILTER (WHERE outcome <> 'repeated') AS l, sum(size) FILTER (WHERE outcome = 'kept') AS k, coalesce(sum(size) FILTER (WHERE outcome = 'duplicate'), 0) AS dd, count(*) FILTER (WHERE outcome = 'duplicate') AS n, count(DISTINCT url) FILTER (WHERE outcome = 'source-map') AS e FROM judged)
 SELECT j.l + a.l AS logical_bytes, j.k + a.w AS physical_bytes, j.l + a.l - j.k - a.w AS bytes_saved, dd AS deduplicated_bytes, j.n AS duplicate_bodies, j.n AS alias_count, a.d AS duplicate_api_bodies, e AS exclusions, 3 * e AS excluded_bytes_reported FROM j, a"""),
    "deflated_archive": "SELECT count(*) AS file_count, sum(strlen(html) + 10000) AS physical_bytes, true AS halved, true AS saved FROM pages",
    "hydrated_bodies": "SELECT page_id, CASE WHEN page_id % 2 = 0 OR page_id % 7 <> 0 THEN CAST(strlen(html) AS BIGINT) END AS size, CASE WHEN (page_id % 2 = 0 OR page_id % 7 <> 0) AND page_id % 5 <> 0 THEN length(html) END AS characters FROM pages",
    "mission_records": "SELECT page_id % 20 AS mission_id, count(*) AS bodies, CAST(sum(strlen(html)) AS BIGINT) AS size, false AS inline FROM pages GROUP BY 1",
    "archive_manifests": """WITH f AS (SELECT page_id // 50 AS archive, 'assets/' || page_id || '.html' AS path, strlen(html) AS size, sha256(html) AS sha FROM pages)
SELECT archive, sha256('{"schemaVersion":1,"fileCount":' || count(*) || ',"files":[' || string_agg('{"path":"' || path || '","size":' || size || ',"sha256":"' || sha || '"}', ',' ORDER BY path) || ']}') AS sha FROM f GROUP BY 1""",
    "byte_budget": with_(RESPONSES, "SELECT id, sum(size) OVER w AS so_far, sum(size) OVER w - size < 300000 AS kept FROM responses WHERE size IS NOT NULL WINDOW w AS (PARTITION BY mission_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)"),
    "validation_status":
        "WITH n AS (SELECT count(*) FILTER (WHERE page_id % 10 = 0) + count(*) FILTER (WHERE page_id % 8 = 0) AS c, count(*) FILTER (WHERE page_id % 25 = 0) AS v FROM pages) "
        "SELECT 'partial' AS status, c + v AS issue_count, 0 AS info_count, 'capture-miss=' || c || ',privacy-risk=' || v AS categories FROM n",
    "user_status": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ready' WHEN page_id % 5 >= 3 AND page_id % 7 >= 4 AND page_id % 2 = 0 THEN 'partial' WHEN page_id % 3 = 1 THEN 'failed' ELSE 'partial' END AS status FROM pages",
    "route_decisions": f"WITH {_DECIDE_SQL}",
    "crawl_reachable":
        "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), w AS (SELECT 1::BIGINT AS p, 0 AS depth UNION SELECT "
        "CASE WHEN s = 0 THEN (2 * p + 1) % n.n ELSE (3 * p + 2) % n.n END, depth + 1 FROM w, n, (VALUES (0), (1)) v(s) WHERE depth < 24) "
        "SELECT CAST(p AS VARCHAR) AS url, min(depth) AS depth FROM w GROUP BY 1",
    "body_chunks": "SELECT CAST(page_id AS VARCHAR) AS storage_key, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha, true AS complete FROM pages",
    "committed_bodies":
        "SELECT CAST(doc_id AS VARCHAR) AS write_id, 'sha256:' || sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY text "
        "ORDER BY doc_id) > 1 AS duplicate FROM documents WHERE doc_id % 10 <> 0",
    "orphan_bodies": with_(RESPONSES,
        ", o AS (SELECT mission_id, content_hash FROM responses WHERE content_hash IS NOT NULL UNION ALL SELECT (mission_id + 1) % 20, content_hash FROM responses "
        "WHERE content_hash IS NOT NULL AND event_id % 50 = 0) SELECT DISTINCT content_hash FROM o WHERE mission_id = 3 AND content_hash NOT IN (SELECT content_hash FROM o "
        "WHERE mission_id <> 3)"),
    "mission_recovery": with_(views.REQUESTS, f", m AS (SELECT user_id AS mission_id, max(ts) AS ts, {list(_STATES)}[user_id % 6 + 1] AS s FROM requests GROUP BY user_id) SELECT mission_id, CASE WHEN s IN ('starting', 'capturing', 'finalizing', 'building') THEN 'interrupted' ELSE s END AS state, CASE WHEN s IN ('starting', 'capturing', 'finalizing', 'building') THEN 'recoverable' ELSE 'none' END AS recovery, ts FROM m"),
    "quota_status":
        "SELECT doc_id, greatest(0, 67108864 - doc_id * 100000 - 16777216) AS available, n_chars * 10000 >= 16777216 AS checked, n_chars * 10000 < 16777216 OR n_chars * 10000 <= greatest(0, 67108864 - doc_id * 100000 - 16777216) AS fits "
        "FROM documents",
}
