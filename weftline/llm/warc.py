"""WARC archives through a table of payload chunks.

A payload is never handled whole in Python: it is a run of rows (record, chunk number, bytes) of at most CHUNK bytes, on the
way out as on the way in, and each row carries what the digest needs from the rows before it. Records are written as
gzip members of their own, in files that tasks write under names of their own; a manifest that Spark commits says which
files count, so a task that is run again leaves no trace in what is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import document_columns, numbered, shared_dir, stored

CHUNK = 1 << 18
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def payload_chunks(pages: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of rows (row_no, payload binary): (row_no, chunk, last, data), an empty payload is one empty chunk."""
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int") - 1
    numbers = pages.withColumn("last_chunk", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last_chunk"))))
    # numbers first, then a piece for each: no row ever holds more than its payload and one chunk
    return numbers.withColumn("data", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))).withColumn("last", F.col("chunk") == F.col("last_chunk")).drop("payload", "last_chunk")


def digested(chunks: DataFrame) -> DataFrame:
    """(row_no, payload_bytes, payload_digest) of a chunk table whose partitions hold the chunks of a record one after another."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for row, last, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = data.as_buffer()
                state.update(part)
                size += part.size
                if last:
                    out.append((row, size, base32(state.digest())))
                    state, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["row_no", "payload_bytes", "payload_digest"])

    return chunks.select("row_no", "last", "data").mapInArrow(digest, "row_no long, payload_bytes long, payload_digest string")


def classified(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type, and of revisits the row and id of the record they refer to, to rows (row_no, record_id, payload_bytes, payload_digest).

    Of equal payloads of at least least_bytes the largest id (null smallest, then the largest row_no) is the response.
    """
    long_enough = F.col("payload_bytes") >= least_bytes
    first = digests.where(long_enough).groupBy("payload_digest").agg(F.max(F.struct(F.col("record_id").isNotNull(), "record_id", "row_no")).alias("head"))
    joined = digests.join(first, "payload_digest", "left")
    revisit = F.coalesce(long_enough & (F.col("head.row_no") != F.col("row_no")), F.lit(False))
    return joined.select(
        "row_no", "record_id", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head.record_id")).alias("refers_to"), F.when(revisit, F.col("head.row_no")).alias("refers_row"),
    )


def _record_urn(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record-{row}')}>"


def _open(path: str):  # noqa: ANN202
    """The file system of a path and the path in it; object stores go by other names in Hadoop."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Writes chunk rows of records as .warc.gz files below path; returns the manifest (file, records, bytes), stored.

    records: row_no, record_id, url, record_type, payload_bytes, payload_digest, refers_to, refers_row, chunk, last, data; the chunks of a
    record one after another. Revisits have one empty chunk.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = _open(path)
        store.create_dir(top, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        sink, n, out = None, 0, None
        for batch in batches:
            rows = batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()
            for row, data in zip(rows, batch.column("data"), strict=True):
                sink = sink or store.open_output_stream(f"{top}/{name}", compression=None)
                if row["chunk"] == 0:
                    out = zlib.compressobj(6, zlib.DEFLATED, 31)
                    sink.write(out.compress(_header(row)))
                sink.write(out.compress(data.as_buffer()))
                if row["last"]:
                    sink.write(out.compress(b"\r\n\r\n") + out.flush())
                    n += 1
        if sink:
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return stored(records.mapInArrow(write, "file string, records long, bytes long"), f"{path}/manifest")


def _header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    fields = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": _record_urn(row["row_no"]), "WARC-Date": NO_DATE, "WARC-Target-URI": None if row["url"] is None else "".join(row["url"].split()),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "WARC-Profile": REVISIT_PROFILE if revisit else None, "WARC-Refers-To": _record_urn(row["refers_row"]) if revisit else None,
        "X-Record-Key": row["record_id"], "X-Row": row["row_no"], "X-Refers-To-Key": row["refers_to"], "Content-Type": "text/html; charset=utf-8", "Content-Length": 0 if revisit else row["payload_bytes"],
    }
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None) + b"\r\n"


class _Member:
    """Reads the header of a record from a stream of bytes, then hands out its payload as it comes."""

    def __init__(self) -> None:
        self.head, self.fields, self.left = b"", None, 0

    def feed(self, data: bytes) -> bytes:
        """What of data belongs to the payload."""
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return b""
            lines = self.head[:end].decode("utf-8").split("\r\n")
            if lines[0].encode() + b"\r\n" != VERSION:
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"])
            data, self.head = self.head[end + 4 :], b""
        part = data[: self.left]
        self.left -= len(part)
        return part


def _records(stream, chunk: int) -> Iterator[tuple[dict, int, bytes, bool]]:  # noqa: ANN001
    """(header fields, chunk number, bytes, last) of every record of a .warc.gz stream, a chunk at a time."""
    member, inflate, number, held = _Member(), zlib.decompressobj(31), 0, b""
    pending = b""
    while True:
        data = pending or stream.read(chunk)
        if not data:
            if member.fields is not None or member.head:
                raise ValueError("the archive ends within a record")
            return
        held += member.feed(inflate.decompress(data, chunk))
        pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        while len(held) >= chunk and (member.left or len(held) > chunk):
            yield member.fields, number, held[:chunk], False
            number, held = number + 1, held[chunk:]
        if inflate.eof:
            if member.fields is None or member.left:
                raise ValueError("a record is shorter than its header says")
            yield member.fields, number, held, True
            member, inflate, number, held = _Member(), zlib.decompressobj(31), 0, b""


def read_warc(spark: SparkSession, path: str, *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of all records of the archives at path, one task for some files; without data each record has only the row of its last chunk.

    Columns: row_no, record_id, record_type, refers_to, refers_urn, record_urn, header_digest, chunk, last, data, and carried from chunk to chunk:
    so_far (payload bytes up to the end of the chunk) and digest (base32 SHA-1 of them).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    rows, held, state, so_far = [], 0, None, 0
                    for fields, number, data, last in _records(stream, chunk):
                        if number == 0:
                            state, so_far = hashlib.sha1(), 0
                        state.update(data)
                        so_far += len(data)
                        key, refers, row = fields.get("X-Record-Key"), fields.get("X-Refers-To-Key"), int(fields["X-Row"])
                        if not (with_data or last):
                            continue
                        rows.append((row, key and int(key), fields["WARC-Type"], refers and int(refers), fields.get("WARC-Refers-To"), fields["WARC-Record-ID"], fields["WARC-Payload-Digest"][5:], number, last, data if with_data else None, so_far, base32(state.digest())))
                        held += len(data)
                        if held >= 4 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    files = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest").select("file")
    return files.repartition(F.col("file")).mapInArrow(read, "row_no long, record_id long, record_type string, refers_to long, refers_urn string, record_urn string, header_digest string, chunk int, last boolean, data binary, so_far long, digest string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string())
    names = ["row_no", "record_id", "record_type", "refers_to", "refers_urn", "record_urn", "header_digest", "chunk", "last", "data", "so_far", "digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Writes a record for each row, later ones of equal payload as revisits; returns the manifest.

    Payloads are strings (written in UTF-8) or binary; null is empty. Repeated rows are records of their own. A record without url has
    no WARC-Target-URI; white space in a url is left out. An empty table writes no archive. pages is read once and stored with a number for each row.
    """
    plain = document_columns(pages, id_col, url_col, payload_col).toDF("record_id", "url", "payload")
    plain = numbered(plain.select(F.col("record_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload")))
    keys = plain.select("row_no", "record_id")
    digests = digested(payload_chunks(plain.select("row_no", "payload"), chunk=chunk)).join(keys, "row_no")
    types = stored(classified(digests, least_bytes))
    own = types.drop("record_id")
    rows = plain.join(own, "row_no").withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    return write_warc(payload_chunks(rows, chunk=chunk), path)


def read_back(spark: SparkSession, path: str, *, chunk: int = CHUNK) -> DataFrame:
    """A row per record of the archives: (record_id, payload_bytes, payload_digest, record_type, refers_to), of the full payload.

    A response's figures come from its bytes; a revisit's from the response that it refers to.
    """
    ends = stored(read_warc(spark, path, chunk=chunk, with_data=False).drop("data"))
    responses = ends.where("record_type = 'response'").select("record_id", F.col("so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    referred = ends.where("record_type = 'response'").select(F.col("record_urn").alias("refers_urn"), F.col("so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    revisits = ends.where("record_type = 'revisit'").join(referred, "refers_urn").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)


def archive_and_read(pages: DataFrame, *, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives below path (a new shared folder without one) and reads them back: (record_id, payload_bytes, payload_digest, record_type, refers_to).

    A null payload is empty; a null URL isn't written; repeated rows are records of their own, of which one is the response. An empty table gives an empty result.
    """
    path = path or shared_dir(pages.sparkSession)
    archive(pages, path, least_bytes=least_bytes, id_col=id_col, url_col=url_col, payload_col=payload_col)
    return read_back(pages.sparkSession, path)
