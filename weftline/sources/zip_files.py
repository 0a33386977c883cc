"""ZIP archives of any size: written by many tasks as segments, read by many tasks by ranges.

Members are deflated where they are. A running sum of their sizes gives each its place, so that tasks write neighbouring members, and neighbouring entries of the
directory, to files of their own; these segments, one after another, are the archive. Offsets beyond 4 GB and many members are written as ZIP64 does. Which segments
count, and where each begins, is a table that Spark commits.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import ranks
from .tables import materialized

#: Fixed values of the format: signatures, 1980-01-01, UTF-8 names, DEFLATE, and what a 32-bit field holds at most.
_MEMBER, _ENTRY, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_DATE, _UTF8, _DEFLATE, _MOST, _MOST_ENTRIES = 0x21, 0x800, 8, 0xFFFFFFFF, 0xFFFF
_VERSION, _VERSION64 = 20, 45

MANIFEST = "archive string, at long, size long, file string"


def opened(path: str):  # noqa: ANN201
    """The file system of a path and the path in it; object stores go by other names in Hadoop."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}://{rest.lstrip('/') if scheme != 'file' else '/' + rest.lstrip('/')}")


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, path, crc, size, data) with the data deflated."""
    for batch in batches:
        for archive, path, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            plain = data.as_buffer() if data.is_valid else pa.py_buffer(b"")
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(plain) + packer.flush()
            yield pa.RecordBatch.from_arrays([pa.array([archive.as_py()], pa.string()), pa.array([path.as_py()], pa.string()), pa.array([zlib.crc32(plain)], pa.int64()), pa.array([len(plain)], pa.int64()), pa.array([packed], pa.binary())], names=["archive", "path", "crc", "size", "data"])


def _member(name: bytes, crc: int, size: int, packed: int) -> bytes:
    return _MEMBER + struct.pack("<5H3L2H", _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), 0) + name


def _entry(name: bytes, crc: int, size: int, packed: int, at: int) -> bytes:
    far = at >= _MOST
    extra = struct.pack("<2HQ", 1, 8, at) if far else b""
    version = _VERSION64 if far else _VERSION
    return _ENTRY + struct.pack("<6H3L5H2L", version, version, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, min(at, _MOST)) + name + extra


def _end(entries: int, size: int, at: int) -> bytes:
    """What closes an archive whose directory of so many entries and bytes is at a place."""
    last = _END + struct.pack("<4H2LH", 0, 0, min(entries, _MOST_ENTRIES), min(entries, _MOST_ENTRIES), min(size, _MOST), min(at, _MOST), 0)
    if entries < _MOST_ENTRIES and size < _MOST and at < _MOST:
        return last
    end64 = _END64 + struct.pack("<Q2H2L4Q", 44, _VERSION64, _VERSION64, 0, 0, entries, entries, size, at)
    return end64 + _LOCATOR + struct.pack("<LQL", 0, at + size, 1) + last


def _written(rows: DataFrame, folder: str, piece) -> DataFrame:  # noqa: ANN001
    """The manifest of rows (archive, at, ...), which are written one after another as piece makes bytes of each; a file for each archive in a task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        store.create_dir(top, recursive=True)
        own, sink, done = None, None, []

        def close() -> None:
            if sink:
                done.append((*own, sink.tell(), name))
                sink.close()

        for batch in batches:
            told = batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()
            data = batch.column(batch.schema.get_field_index("data")) if "data" in batch.schema.names else [None] * len(told)
            for row, content in zip(told, data, strict=True):
                if own is None or row["archive"] != own[0]:
                    close()
                    own, name = (row["archive"], row["at"]), f"segment-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{top}/{name}", compression=None)
                head = piece(row)
                sink.write(head)
                if content is not None:
                    sink.write(content.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["archive", "at", "size", "file"])

    return rows.mapInArrow(write, MANIFEST)


def write_zip(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (archive, path, bytes) as segments below folder; returns the manifest (archive, at, size, file), stored at folder/manifest.

    Members go by path; null bytes are an empty file. Paths of an archive must differ. A manifest that was there is replaced once all segments are written.
    """
    spark = files.sparkSession
    packed = materialized(files.select("archive", "path", "bytes").mapInArrow(_deflated, "archive string, path string, crc long, size long, data binary"))
    name = F.octet_length("path").cast("long")
    sizes = packed.select("archive", "path", "crc", "size", F.octet_length("data").cast("long").alias("packed"))
    placed = ranks.running(ranks.spread(sizes, ["archive"], ["path"]), ["archive"], ["path"], F.lit(30) + name + F.col("packed"), "upto")
    placed = materialized(placed.withColumn("at", F.col("upto") - 30 - name - F.col("packed")).drop("upto"))
    members = packed.select("archive", "path", "data").join(placed, ["archive", "path"]).repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    parts = [_written(members.select("archive", "at", "path", "crc", "size", "packed", "data"), folder, lambda r: _member(r["path"].encode(), r["crc"], r["size"], r["packed"]))]
    totals = placed.groupBy("archive").agg(F.max(F.col("at") + 30 + name + F.col("packed")).alias("directory"), F.count(F.lit(1)).alias("entries"))
    length = F.lit(46) + name + F.when(F.col("at") >= _MOST, 12).otherwise(0)
    listed = materialized(ranks.running(ranks.spread(placed, ["archive"], ["path"]), ["archive"], ["path"], length, "upto"))
    # one row for each archive goes along with its entries: as many rows as archives
    entries = listed.join(totals, "archive").select("archive", (F.col("directory") + F.col("upto") - length).alias("at"), "path", "crc", "size", "packed", F.col("at").alias("member_at"))
    entries = entries.repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    parts.append(_written(entries, folder, lambda r: _entry(r["path"].encode(), r["crc"], r["size"], r["packed"], r["member_at"])))
    ends = listed.groupBy("archive").agg(F.max("upto").alias("bytes")).join(totals, "archive").select("archive", (F.col("directory") + F.col("bytes")).alias("at"), "bytes", "entries", "directory")
    parts.append(_written(ends.repartitionByRange("archive"), folder, lambda r: _end(r["entries"], r["bytes"], r["directory"])))
    manifest = parts[0].unionByName(parts[1]).unionByName(parts[2])
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Segments(io.RawIOBase):
    """The segments of an archive as one file that can be read anywhere."""

    def __init__(self, folder: str, rows: list):
        self.store, self.top = opened(folder)
        self.rows = sorted((r["at"], r["size"], r["file"]) for r in rows)
        self.starts = [r[0] for r in self.rows]
        self.size, self.place, self.held = max((at + n for at, n, _ in self.rows), default=0), 0, (None, None)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = 0) -> int:
        self.place = offset + (0, self.place, self.size)[whence]
        return self.place

    def readinto(self, buffer) -> int:  # noqa: ANN001
        if self.place >= self.size:
            return 0
        at, size, file = self.rows[bisect_right(self.starts, self.place) - 1]
        if self.held[0] != file:
            self.held = (file, self.store.open_input_file(f"{self.top}/{file}"))
        data = self.held[1].read_at(min(len(buffer), at + size - self.place), self.place - at)
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)


def segments(spark: SparkSession, folder: str, archive: str) -> io.BufferedReader:
    """An archive below folder as a file, as zipfile.ZipFile takes it; the driver reads its list of segments, as many as tasks wrote."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("archive") == archive).collect()
    return io.BufferedReader(Segments(folder, rows), 1 << 20)


# reading ---------------------------------------------------------------------------------------------------------------

#: So many bytes of an archive are read by a task, about.
SHARE_BYTES = 64 << 20


class Share(InputPartition):
    """The members of an archive that begin in a range of its bytes; segments names what the archive is made of, or nothing if it is a file."""

    def __init__(self, archive: str, path: str, low: int, high: int, segments: list[tuple[int, int, str]] | None = None):
        self.archive, self.path, self.low, self.high, self.segments = archive, path, low, high, segments


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def partitions(self) -> list[Share]:
        """Shares of the archives below the path, by their sizes or their manifest alone; the directories are read by the tasks."""
        from pyarrow import dataset, fs

        store, top = opened(self.path)
        if store.get_file_info(f"{top}/manifest/_SUCCESS").type == fs.FileType.File:
            files = [f.path for f in store.get_file_info(fs.FileSelector(f"{top}/manifest")) if f.path.endswith(".parquet")]
            made: dict[str, list[tuple[int, int, str]]] = {}
            for r in dataset.dataset(files, filesystem=store, format="parquet").to_table().to_pylist():
                made.setdefault(r["archive"], []).append((r["at"], r["size"], r["file"]))
            return [Share(name, self.path, low, low + self.share, rows) for name, rows in sorted(made.items()) for low in range(0, max(at + n for at, n, _ in rows), self.share)]
        info = store.get_file_info(top)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if info.type == fs.FileType.Directory else [info]
        before = self.path[: len(self.path) - len(top)] if self.path.endswith(top) else ""  # scheme and host
        archives = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        return [Share(before + path, before + path, low, low + self.share) for path, size in archives for low in range(0, max(size, 1), self.share)]

    def read(self, partition: Share) -> Iterator[tuple]:
        import zipfile

        if partition.segments:
            raw = io.BufferedReader(Segments(partition.path, [dict(zip(("at", "size", "file"), r, strict=True)) for r in partition.segments]), 1 << 20)
        else:
            store, path = opened(partition.path)
            raw = store.open_input_file(path)
        with raw, zipfile.ZipFile(raw) as archive:
            for member in archive.infolist():
                if partition.low <= member.header_offset < partition.high and not member.is_dir():
                    yield partition.archive, member.filename, archive.read(member)


class ZipSource(DataSource):
    """format("zip_members"): the members of all .zip files below a path, or of the archives that write_zip left there, as (archive, path, bytes); each archive is read by
    as many tasks as it has shares of option share bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, path string, bytes binary"

    def reader(self, schema) -> _ZipReader:  # noqa: ANN001, ARG002
        return _ZipReader(self.options["path"], int(self.options.get("share", SHARE_BYTES)))


def members(spark: SparkSession, path: str, share: int = SHARE_BYTES) -> DataFrame:
    """(archive, path, bytes) of the members of ZIP files below a path, or of archives written by write_zip, by ranges."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("share", str(share)).load(path)
