"""The archive catalog: which bodies are kept, under which paths, and what that saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media, paths, urls
from ..sources.tables import materialized
from . import names


def judge(resources: DataFrame) -> DataFrame:
    """Resources (position, url, mime_type, content_hash, size, route_page, route_id) in the order of position, with outcome and dedup_key.

    outcome: repeated (a URL, or of route pages a route, that was there before), source-map, duplicate (an equal body under its key), kept. Each rule is one window
    over all rows; rows that a rule doesn't ask about have a key of their own.
    """
    alone = F.concat(F.lit("#"), F.col("position").cast("string"))
    r = resources.withColumn("url", urls.normalized(F.col("url")))
    r = r.withColumn("identity", F.when(F.col("route_page"), F.concat(F.lit("route:"), F.coalesce("route_id", alone))).otherwise(F.concat(F.lit("url:"), F.col("url"))))
    # a route page doesn't look its URL up, but it is found there by what comes after
    r = r.withColumn("by_identity", F.row_number().over(Window.partitionBy("identity").orderBy("position")))
    page_before = F.coalesce(F.max(F.col("route_page")).over(Window.partitionBy("url").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    r = r.withColumn("repeated", (F.col("by_identity") > 1) | (~F.col("route_page") & page_before))
    r = r.withColumn("is_map", ~F.col("repeated") & media.is_source_map(F.col("url"), F.col("mime_type")))
    r = r.withColumn("dedup_key", F.when(F.col("repeated") | F.col("is_map"), "").otherwise(paths.dedup_key(F.col("content_hash"), F.col("mime_type"), F.col("url"), F.col("route_page"))))
    keyed = F.col("dedup_key") != ""
    first = F.row_number().over(Window.partitionBy(F.when(keyed, F.col("dedup_key")).otherwise(alone)).orderBy("position")) == 1
    outcome = F.when(F.col("repeated"), "repeated").when(F.col("is_map"), "source-map").when(keyed & ~first, "duplicate").otherwise("kept")
    return r.withColumn("outcome", outcome).select("position", "url", "mime_type", "content_hash", "size", "route_page", "route_id", "outcome", "dedup_key")


def catalog(resources: DataFrame) -> DataFrame:
    """Judged resources, kept ones with local_path: the first free of its path, -2, -3 and so on, as they come."""
    judged = materialized(judge(resources))
    kept = judged.where("outcome = 'kept'").withColumn("base_path", paths.archive_path(F.col("url"), F.col("mime_type")))
    rest = judged.where("outcome <> 'kept'").withColumn("local_path", F.lit(None).cast("string"))
    return names.named(kept).drop("base_path").unionByName(rest)


def catalog_stats(judged: DataFrame) -> DataFrame:
    """One row of bytes: logical (all but repeated), physical (kept), deduplicated, and how many bodies were duplicates or excluded."""
    size = F.col("size")
    total = lambda *names: F.coalesce(F.sum(F.when(F.col("outcome").isin(*names), size)), F.lit(0))
    return judged.agg(
        total("source-map", "duplicate", "kept").alias("logical_bytes"), total("kept").alias("physical_bytes"), total("duplicate").alias("deduplicated_bytes"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate_bodies"),
        total("source-map").alias("excluded_bytes"), F.count_if(F.col("outcome") == "kept").alias("resources"),
    )


def aliases(judged: DataFrame) -> DataFrame:
    """URLs of duplicates beside the kept resource that answers for them, and its local_path where resources were named; judged is a stored table."""
    told = [c for c in ("local_path",) if c in judged.columns]
    kept = judged.where("outcome = 'kept' and dedup_key <> ''").select("dedup_key", F.col("url").alias("kept_url"), *told)
    return judged.where("outcome = 'duplicate'").select("url", "dedup_key").join(kept, "dedup_key").select("url", "kept_url", *told)


def large_media(judged: DataFrame, threshold: int = media.LARGE_MEDIA_BYTES) -> DataFrame:
    """One row: kept audio and video of at least threshold bytes, how many and how large."""
    large = judged.where((F.col("outcome") == "kept") & media.is_large_media(F.col("mime_type"), F.col("size"), threshold))
    return large.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def snapshot_bodies(snapshots: DataFrame, resources: DataFrame) -> DataFrame:
    """Snapshots (position, local_path, content_hash, size) with the path they are served from.

    A body that a resource (content_hash, local_path) or an earlier snapshot has is not written again.
    """
    held = resources.where("content_hash is not null").groupBy("content_hash").agg(F.max_by("local_path", "position").alias("resource_path"))
    first = Window.partitionBy("content_hash").orderBy("position")
    joined = snapshots.join(held, "content_hash", "left")
    ranked = joined.where("content_hash is not null").withColumn("first_path", F.first("local_path").over(first)).withColumn("n", F.row_number().over(first))
    s = ranked.unionByName(joined.where("content_hash is null").withColumn("first_path", F.col("local_path")).withColumn("n", F.lit(1)))
    hashed = F.col("content_hash").isNotNull()
    path = F.when(hashed & F.col("resource_path").isNotNull(), F.concat(F.lit("/"), F.col("resource_path"))).when(hashed, F.col("first_path")).otherwise(F.col("local_path"))
    written = ~hashed | (F.col("resource_path").isNull() & (F.col("n") == 1))
    return s.select("position", "content_hash", "size", path.alias("served_from"), written.alias("written"))


def estimate(files: DataFrame) -> DataFrame:
    """One row: the expected archive of files (path, mime_type, size): bodies by ratio, 92 bytes and twice the path each, 22 at the end."""
    compressed = media.estimated_size(F.col("path"), F.col("mime_type"), F.col("size"))
    totals = files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("physical_bytes"), F.coalesce(F.sum(compressed), F.lit(0)).alias("compressed"), F.coalesce(F.sum(92 + 2 * F.octet_length("path")), F.lit(0)).alias("overhead"))
    return totals.select("file_count", "physical_bytes", (F.col("compressed") + F.col("overhead") + 22).alias("estimated_archive_bytes"), F.greatest(F.lit(0), F.col("physical_bytes") - F.col("compressed")).alias("estimated_bytes_saved"))


def page_routes(pages: DataFrame) -> DataFrame:
    """Path keys of pages (position, url, local_path) and the file that answers each; later pages win, the root is left out."""
    keyed = pages.withColumn("path_key", urls.path_key(F.col("url"))).where("path_key <> '/'")
    return keyed.groupBy("path_key").agg(F.max_by("local_path", "position").alias("local_path"))


def resource_routes(resources: DataFrame) -> DataFrame:
    """Paths with queries and the file that answers each, unless resources of several origins share one."""
    keyed = resources.withColumn("path_key", urls.resource_key(F.col("url"))).withColumn("origin", urls.origin(F.col("url")))
    return keyed.groupBy("path_key").agg(F.max_by("local_path", "position").alias("local_path"), F.count_distinct("origin").alias("origins")).where("origins = 1").drop("origins")


def exclusions(*lists: DataFrame) -> DataFrame:
    """Exclusions (kind, url, reason, bytes) of all lists, each (kind, url, reason) once with its smallest size."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    return every.groupBy("kind", "url", "reason").agg(F.min("bytes").alias("bytes"))


def optimization_summary(judged: DataFrame, excluded: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row of what the archive saves: bytes of resources and of snapshots (size, written), aliases, and bytes of distinct exclusions."""
    apis = snapshots.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("api_logical_bytes"), F.coalesce(F.sum(F.when(F.col("written"), F.col("size"))), F.lit(0)).alias("api_physical_bytes"), F.count_if(~F.col("written")).alias("duplicate_api_bodies"))
    left = exclusions(excluded).agg(F.count(F.lit(1)).alias("exclusions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("excluded_bytes_reported"))
    stats = catalog_stats(judged).drop("excluded_bytes").withColumn("alias_count", F.col("duplicate_bodies"))  # each duplicate is an alias of what is kept
    total = stats.join(apis).join(left)  # one row each
    logical, physical = F.col("logical_bytes") + F.col("api_logical_bytes"), F.col("physical_bytes") + F.col("api_physical_bytes")
    return total.select(logical.alias("logical_bytes"), physical.alias("physical_bytes"), F.greatest(F.lit(0), logical - physical).alias("bytes_saved"), "deduplicated_bytes", "duplicate_bodies", "alias_count", "duplicate_api_bodies", "exclusions", "excluded_bytes_reported")


def deflated(files: DataFrame) -> DataFrame:
    """As estimate, with the bodies of files (path, body binary) really deflated."""
    sized = files.select("path", F.octet_length("body").cast("long").alias("size"), media.deflated_size(F.col("body")).alias("packed"))
    totals = sized.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("physical_bytes"), F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"), F.coalesce(F.sum(92 + 2 * F.octet_length("path")), F.lit(0)).alias("overhead"))
    return totals.select("file_count", "physical_bytes", (F.col("packed") + F.col("overhead") + 22).alias("estimated_archive_bytes"), F.greatest(F.lit(0), F.col("physical_bytes") - F.col("packed")).alias("estimated_bytes_saved"))
