"""A store of bodies that grows by batches: each content once, whoever captured it, and gone with the last mission that owns it.

The store is a folder that all machines share. A batch writes its rows to folders of its own and then a version: a small table that names every folder that counts.
Readers take the last version, so a batch that was broken off leaves nothing to be seen, and one that comes again is known by its id. Bodies
that are there already are found by their hash in one join of narrow rows; only new ones are cut into chunks and written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .storage import CHUNK_BYTES, body_chunks

_SCHEMAS = {
    "bodies": "content_hash string, storage_key string, size long, chunk_count int, mime_type string, batch_id long",
    "owners": "mission_id long, content_hash string, batch_id long",
    "chunks": "storage_key string, index int, bytes binary",
}
_FOLDERS = "kind string, folder string"


@dataclass(frozen=True)
class Version:
    """What a store holds after so many changes: the folders of each table, and the batches that made them."""

    number: int
    folders: tuple[tuple[str, str], ...]
    batches: frozenset[int]


class BodyStore:
    """The store below a path. One writer at a time: of two that write a version of the same number the later fails."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = CHUNK_BYTES):
        self.spark, self.path, self.chunk = spark, path.rstrip("/"), chunk

    # versions ---------------------------------------------------------------------------------------------------------

    def _files(self, folder: str):  # noqa: ANN202
        """The file system of a folder and its path there."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _inside(self, folder: str) -> list[str]:
        files, at = self._files(folder)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def version(self) -> Version:
        """The last version whose writing was finished."""
        numbers = sorted((int(n) for n in self._inside(f"{self.path}/versions") if n.isdigit()), reverse=True)
        for number in numbers:
            if "_SUCCESS" in self._inside(f"{self.path}/versions/{number}"):
                rows = self.spark.read.schema(_FOLDERS).parquet(f"{self.path}/versions/{number}").collect()  # a row for each folder and batch
                batches = frozenset(int(r["folder"]) for r in rows if r["kind"] == "batch")
                return Version(number, tuple(sorted((r["kind"], r["folder"]) for r in rows if r["kind"] != "batch")), batches)
        return Version(0, (), frozenset())

    def _publish(self, before: Version, folders: list[tuple[str, str]], batches: frozenset[int]) -> Version:
        rows = [*folders, *(("batch", str(b)) for b in sorted(batches))]
        self.spark.createDataFrame(rows, _FOLDERS).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/{before.number + 1}")
        return Version(before.number + 1, tuple(sorted(folders)), batches)

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, str]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return kind, folder

    def table(self, kind: str, version: Version | None = None) -> DataFrame:
        """bodies (content_hash, storage_key, size, chunk_count, mime_type, batch_id), owners (mission_id, content_hash, batch_id) or chunks (storage_key, index, bytes)."""
        folders = [f"{self.path}/{f}" for k, f in (version or self.version()).folders if k == kind]
        return self.spark.read.schema(_SCHEMAS[kind]).parquet(*folders) if folders else self.spark.createDataFrame([], _SCHEMAS[kind])

    # changes ----------------------------------------------------------------------------------------------------------

    def stage(self, batch_id: int, writes: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Writes what a batch brings and returns (results, folders); nothing of it counts until the folders are published.

        writes: (write_id, mission_id, position, expected_size, mime_type, body binary), write_id without repeats. Of equal bodies the first by position gives the storage key. A write
        of another size than expected is aborted. results: (write_id, mission_id, content_hash, size, state, duplicate), of aborted ones without hash.
        """
        before = self.version()
        size = F.octet_length("body").cast("long")
        fits = size == F.coalesce(F.col("expected_size"), size)
        told = writes.select("write_id", "mission_id", "position", "mime_type", size.alias("size"), fits.alias("fits"), F.when(fits, paths.content_hash(F.col("body"))).alias("content_hash"))
        told = self._stored("hashed", told)
        good = told.where("fits")
        first = good.groupBy("content_hash").agg(F.min_by(F.struct("write_id", "mission_id", "size", "mime_type"), F.struct("position", "write_id")).alias("first"))
        new = first.join(self.table("bodies", before).select("content_hash"), "content_hash", "left_anti").select("content_hash", "first.*")
        key = F.concat(F.lit("capture/"), F.col("mission_id").cast("string"), F.lit("/body/"), F.lit(f"{batch_id}-"), F.col("write_id").cast("string"))
        new = self._stored("new", new.withColumn("storage_key", key))
        chunks = body_chunks(writes.select("write_id", "body").join(new.select("write_id", "storage_key"), "write_id").select("storage_key", "body"), self.chunk)
        batch = F.lit(batch_id).cast("long").alias("batch_id")
        owners = good.select("mission_id", "content_hash").distinct().join(self.table("owners", before), ["mission_id", "content_hash"], "left_anti")
        folders = [
            self._write("chunks", chunks),
            self._write("bodies", new.select("content_hash", "storage_key", "size", F.ceil(F.col("size") / self.chunk).cast("int").alias("chunk_count"), "mime_type", batch)),
            self._write("owners", owners.select("mission_id", "content_hash", batch)),
        ]
        state = F.when(F.col("fits"), "committed").otherwise("aborted")
        fresh = new.select("write_id", F.lit(True).alias("fresh"))
        results = told.join(fresh, "write_id", "left").select("write_id", "mission_id", "content_hash", "size", state.alias("state"), (F.col("fits") & F.col("fresh").isNull()).alias("duplicate"))
        return results, folders

    def commit(self, batch_id: int, writes: DataFrame) -> DataFrame | None:
        """Adds a batch and returns its results as stage does; None if the store has the batch already. Fit for foreachBatch: lambda df, n: store.commit(n, df)."""
        before = self.version()
        if batch_id in before.batches:
            return None
        results, folders = self.stage(batch_id, writes)
        results = self._stored("results", results)
        self._publish(before, [*before.folders, *folders], before.batches | {batch_id})
        return results

    def _stored(self, kind: str, rows: DataFrame) -> DataFrame:
        """Rows of a change, below the store, until vacuum."""
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{self._write(kind, rows)[1]}")

    def remove_mission(self, mission_id: int) -> int:
        """Removes a mission and the bodies that no other owns; how many these are. Chunk folders that hold none of them stay as they are."""
        before = self.version()
        owners, bodies = self.table("owners", before), self.table("bodies", before)
        kept = owners.where(F.col("mission_id") != mission_id)
        gone = self._stored("gone", bodies.join(kept.select("content_hash").distinct(), "content_hash", "left_anti").select("storage_key"))
        chunk_folders = [(k, f) for k, f in before.folders if k == "chunks"]
        if chunk_folders:
            read = self.spark.read.schema(_SCHEMAS["chunks"]).parquet(*[f"{self.path}/{f}" for _, f in chunk_folders])
            name = F.regexp_extract("_metadata.file_path", "(chunks/[0-9a-f]{32})/[^/]*$", 1)
            touched = {r[0] for r in read.select(name.alias("folder"), "storage_key").join(gone, "storage_key", "left_semi").select("folder").distinct().collect()}  # folders, not rows
        else:
            touched = set()
        folders = [(k, f) for k, f in chunk_folders if f not in touched]
        if touched:
            rest = self.spark.read.schema(_SCHEMAS["chunks"]).parquet(*[f"{self.path}/{f}" for f in sorted(touched)])
            folders.append(self._write("chunks", rest.join(gone, "storage_key", "left_anti")))
        folders += [self._write("owners", kept), self._write("bodies", bodies.join(gone, "storage_key", "left_anti").select(*bodies.columns))]
        self._publish(before, folders, before.batches)
        return gone.count()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last versions names, and older versions; how many these are. Readers of an older version must have ended."""
        last = self.version()
        finished = [n for n in sorted((int(n) for n in self._inside(f"{self.path}/versions") if n.isdigit())) if n <= last.number]
        kept_versions = finished[-keep:]
        named = {f for n in kept_versions for _, f in [tuple(r) for r in self.spark.read.schema(_FOLDERS).parquet(f"{self.path}/versions/{n}").collect()]}
        unused = [f"versions/{n}" for n in finished if n not in kept_versions]
        unused += [f"{kind}/{name}" for kind in (*_SCHEMAS, "hashed", "new", "gone", "results") for name in self._inside(f"{self.path}/{kind}") if f"{kind}/{name}" not in named]
        for folder in unused:
            files, at = self._files(f"{self.path}/{folder}")
            files.delete(at, True)
        return len(unused)

    # reading ----------------------------------------------------------------------------------------------------------

    def has(self, hashes: DataFrame) -> DataFrame:
        """Which of some hashes (content_hash) the store holds: (content_hash, held)."""
        held = self.table("bodies").select("content_hash", F.lit(True).alias("held"))
        return hashes.join(held, "content_hash", "left").withColumn("held", F.coalesce("held", F.lit(False)))

    def chunk_rows(self) -> DataFrame:
        """(content_hash, index, bytes) of every body; a body is never one value."""
        return self.table("chunks").join(self.table("bodies").select("storage_key", "content_hash"), "storage_key").select("content_hash", "index", "bytes")
