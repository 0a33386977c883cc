"""Validation of an archive: files, HTML, reported problems, and the verdict."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, urls

DIAGNOSTIC = ("category", "code", "severity", "path", "url", "message")


def _diagnostics(rows: DataFrame, category: str, code: Column | str, severity: Column | str, *, path: Column | None = None, url: Column | None = None, message: Column | str = "") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return rows.select(*_of(rows), F.lit(category).alias("category"), text(code).alias("code"), text(severity).alias("severity"), (none if path is None else path).alias("path"), (none if url is None else url).alias("url"), text(message).alias("message"))


def _of(rows: DataFrame) -> list[str]:
    """The archive of each row, where rows of several are told apart by a column archive."""
    return ["archive"] if "archive" in rows.columns else []


def missing_files(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required paths ([archive,] path, critical) that no file ([archive,] path) of the archive has."""
    wanted = required.withColumn("path", paths.archive_name(F.col("path")))
    there = files.select(*_of(required), paths.archive_name(F.col("path")).alias("path")).distinct()
    lost = wanted.join(there, [*_of(required), "path"], "left_anti")
    return _diagnostics(lost, "rewrite-failure", "required-file-missing", F.when(F.col("critical"), "error").otherwise("warning"), path=F.col("path"), message=F.concat(F.lit("Required archive file is missing: "), F.col("path")))


def scan_html(files: DataFrame) -> DataFrame:
    """Stale integrity attributes, scripts from other hosts, and scripts that a page ([archive,] path, text) loads again."""
    html = files.where(F.rlike(F.lower("path"), F.lit(r"\.html?$")) & F.col("text").isNotNull())
    stale = html.where(F.rlike("text", F.lit(r"""(?i)\bintegrity\s*=\s*["'][^"']+["']""")))
    opens = F.regexp_extract_all("text", F.lit(r"(?i)<script\b([^>]*)>"), 1)
    tags = html.select(*_of(files), "path", F.posexplode(opens).alias("n", "tag"))
    source = F.trim(F.regexp_extract("tag", r"""(?i)\bsrc\s*=\s*["']([^"']+)["']""", 1))
    scripts = tags.withColumn("src", source).where("src <> ''")
    outside = scripts.where(F.rlike("src", F.lit("(?i)^(https?:)?//")))
    again = scripts.withColumn("r", F.row_number().over(Window.partitionBy(*_of(files), "path", F.regexp_replace("src", "#.*$", "")).orderBy("n"))).where("r > 1")
    return (
        _diagnostics(stale, "rewrite-failure", "stale-subresource-integrity", "warning", path=F.col("path"), message="The page still has a stale integrity attribute.")
        .unionByName(_diagnostics(outside, "rewrite-failure", "external-executable-reference", "warning", path=F.col("path"), url=F.col("src"), message="The page still loads a script from another host."))
        .unionByName(_diagnostics(again, "rewrite-failure", "duplicate-executable-reference", "warning", path=F.col("path"), url=F.col("src"), message="The page loads the same script more than once."))
    )


def input_diagnostics(*, unresolved: DataFrame | None = None, unavailable: DataFrame | None = None, misses: DataFrame | None = None, exclusions: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame | None:
    """Problems that capture reported: (url, reason) of resources and pages, (url, reason_code) of replays, (location) of private artifacts, (url, state, decision_reason) of routes."""
    found = []
    if unresolved is not None:
        found.append(_diagnostics(unresolved, "capture-miss", "capture-resource-miss", "warning", url=F.col("url"), message=F.coalesce("reason", F.lit("Required resource was not captured."))))
    if unavailable is not None:
        found.append(_diagnostics(unavailable, "capture-miss", "capture-route-miss", "warning", url=F.col("url"), message=F.coalesce("reason", F.lit("Route was not captured."))))
    if misses is not None:
        found.append(_diagnostics(misses, "capture-miss", F.concat(F.lit("replay-"), F.coalesce("reason_code", F.lit("unsupported"))), "warning", url=F.col("url"), message=F.coalesce("reason_code", F.lit("unsupported"))))
    if exclusions is not None:
        found.append(_diagnostics(exclusions, "privacy-risk", "private-artifact-excluded", "warning", path=F.col("location"), message="An artifact may hold private data and was left out."))
    if routes is not None:
        found.append(_diagnostics(routes.where("state = 'failed'"), "capture-miss", "captured-route-failed", "warning", url=F.col("url"), message=F.coalesce("decision_reason", F.lit("Route capture failed."))))
    return functools.reduce(DataFrame.unionByName, found) if found else None


def validation_routes(resources: DataFrame, roots: DataFrame) -> DataFrame:
    """Routes by which pages of archives are validated: (archive, position, n, route_id, url, local_path, expected_marker).

    resources: archive, position, mime_type, url, route_url, route_id, aliases, local_path; roots: archive, page_url. Of an HTML page its route, its URL and its
    aliases are tried in that order; the root's key and keys that were there before add nothing. The first of a page has the id of its route.
    """
    name = F.coalesce("local_path", "url", F.lit("html"))
    pages = resources.where(F.startswith(F.lower(F.coalesce("mime_type", F.lit(""))), F.lit("text/html"))).withColumn("expected_marker", F.coalesce("route_id", F.concat(F.lit("page:"), paths.short_hash(name))))
    tried = F.filter(F.concat(F.array(F.coalesce("route_url", "url"), "url"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != "")
    tried = pages.select("archive", "position", "route_id", "local_path", "expected_marker", F.posexplode(tried).alias("n", "url")).where(F.rlike("url", F.lit("^[A-Za-z][A-Za-z0-9+.-]*://.")))
    tried = tried.withColumn("key", urls.validation_key(F.col("url")))
    roots = roots.select("archive", urls.validation_key(F.col("page_url")).alias("key"))
    first = tried.join(roots, ["archive", "key"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("archive", "key").orderBy("position", "n"))).where("r = 1")
    leads = F.row_number().over(Window.partitionBy("archive", "position").orderBy("n")) == 1
    route = F.when(leads & F.col("route_id").isNotNull(), F.col("route_id")).otherwise(F.concat(F.lit("route:"), paths.short_hash(F.concat("key", F.lit("\n"), F.coalesce("local_path", F.lit("undefined"))))))
    return first.select("archive", "position", "n", route.alias("route_id"), "url", "local_path", "expected_marker")


def plan_routes(routes: DataFrame, max_routes: int = 40) -> DataFrame:
    """Routes (archive, position, n, route_id, url, local_path, expected_marker) of each archive in order, with defaults and normal paths; over_budget marks what is beyond."""
    rank = F.row_number().over(Window.partitionBy("archive").orderBy("position", "n"))
    name = F.coalesce("route_id", F.concat(F.lit("route-"), F.col("place").cast("string")))
    return routes.withColumn("place", rank).select("archive", "place", name.alias("route_id"), "url", paths.archive_name(F.col("local_path")).alias("local_path"), F.coalesce("expected_marker", name).alias("expected_marker"), (F.col("place") > max_routes).alias("over_budget"))


def finalize(diagnostics: DataFrame, *, cancelled: bool = False, archives: DataFrame | None = None) -> DataFrame:
    """One row: status cancelled, failed (an error), partial (anything but info) or ready; issue, info and category counts.

    With archives (archive) a row for each of them, of the diagnostics (archive, ...) that are its own; those without any are ready.
    """
    own = _of(diagnostics) if archives is not None else []
    severity = F.col("severity")
    by_category = diagnostics.groupBy(*own, "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(severity == "error").alias("errors"), F.count_if(severity != "info").alias("issues"))
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n", "errors", "issues")]
    categories = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "category", F.col("n").cast("string")))), ",").alias("categories")
    total = by_category.groupBy(*own).agg(*sums, categories) if own else by_category.agg(*sums, categories)
    if archives is not None:
        total = archives.select("archive").distinct().join(total, "archive", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    status = F.when(F.lit(cancelled), "cancelled").when(zero("errors") > 0, "failed").when(zero("issues") > 0, "partial").otherwise("ready")
    return total.select(*own, status.alias("status"), zero("issues").alias("issue_count"), (zero("n") - zero("issues")).alias("info_count"), F.coalesce("categories", F.lit("")).alias("categories"))


def user_status(validation: Column, saved_pages: Column, all_pages: Column, saved_files: Column, all_files: Column, failed_routes: Column) -> Column:
    """What users are told: a complete capture is at worst partial."""
    complete = (saved_pages > 0) & (saved_pages >= all_pages) & (saved_files > 0) & (saved_files >= all_files) & (failed_routes == 0)
    return F.when(validation == "ready", "ready").when(complete, "partial").otherwise(validation)
