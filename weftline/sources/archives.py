"""Archives on disk: ZIP files as rows, Parquet results as ZIP files, and the folder scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, paths
from . import zip_files

TYPES = {"html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "json": "application/json", "svg": "image/svg+xml", "txt": "text/plain", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "woff2": "font/woff2", "woff": "font/woff", "wasm": "application/wasm", "webmanifest": "application/manifest+json"}


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the ZIP files below a path as (archive, path, bytes, mime_type, text); text only where the type is text. A large archive is read by many tasks."""
    return _typed(zip_files.members(spark, path))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as (archive, path, bytes, mime_type, text); paths begin below the folder, whatever folders in it are called."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    inner = F.substring("path", len(root) + 2, 1 << 30)
    return _typed(files.select(F.lit(path).alias("archive"), inner.alias("path"), F.col("content").alias("bytes")))


def _typed(entries: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    typed = entries.where(paths.is_safe_path(F.col("path"))).withColumn("mime_type", F.coalesce(table[ending], F.lit("application/octet-stream")))
    return typed.withColumn("text", F.when(media.is_optimizer_text(F.col("mime_type")), F.decode("bytes", "utf-8")))


def manifest(files: DataFrame) -> DataFrame:
    """(archive, path, bytes): a manifest.json for each archive of files (archive, path, bytes), with the size and hash of each in order; to be united with the files."""
    entry = F.struct("path", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))
    listed = files.groupBy("archive").agg(F.array_sort(F.collect_list(entry)).alias("files"))
    return listed.select("archive", F.lit("manifest.json").alias("path"), F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.size("files").alias("fileCount"), "files")).cast("binary").alias("bytes"))
