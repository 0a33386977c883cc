"""What several operators share: intermediate tables, Arrow slices and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the class [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (local masters, as in tests) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "row_no", path: str | None = None) -> DataFrame:
    """df with a number for each row, written with it: another read of an input may be split otherwise, and so numbered otherwise."""
    spark = df.sparkSession
    path, df = path or shared_dir(spark), df.withColumn(name, row_id())
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sendable(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A stored table of narrow rows, marked to be sent to all tasks if it has at most most_rows rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Inner join of a stored table with a stored one that has one row for each key, in which no key becomes a task of its own.

    Keys that stand in more than one of share rows of left are share at most, so what right has of them is sent to all tasks; the rest is shuffled.
    """
    rows = left.count()
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > max(1, rows // share))
    heavy = stored(counts.select(*keys))
    if heavy.isEmpty():
        return left.join(right, keys)
    heavy = F.broadcast(heavy)
    few = F.broadcast(right.join(heavy, keys, "left_semi"))
    return left.join(few, keys).unionByName(left.join(heavy, keys, "left_anti").join(right, keys))


def row_id() -> Column:
    """A number for each row within one read, used to tell repeated rows apart; only a number that is stored may be joined on."""
    return F.monotonically_increasing_id()


#: Rows and bytes that go to Python at once at most; texts may be long, and a task holds several copies of a batch.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Bytes of text that a task works on at once; numbers for each byte and word take about a hundred times this.
SLICE_BYTES = 256 << 10


def document_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller can't clash; the session's Arrow batches become small enough for texts."""
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _number(conf.get(f"spark.sql.execution.arrow.{name}")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return docs.select(*[F.col(f"`{n}`") for n in names])


def _number(size: str) -> int:
    """A size as Spark writes it, without units or in bytes; 0 for other units."""
    return int(size.removesuffix("b")) if size.removesuffix("b").isdigit() else 0


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Slice:
    """Some rows of a string or binary Arrow array as one flat byte array.

    ``data`` holds the bytes of the rows one after another, ``offsets`` (rows + 1) where each begins.
    Null rows are empty; ``null`` marks them.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, null: np.ndarray):
        self.first, self.data, self.offsets, self.null = first, data, offsets, null

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(array: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts an Arrow string array into slices of about max_bytes; a longer row is a slice of its own."""
    wide = pa.large_binary()
    array = array.cast(pa.large_string()).cast(wide) if not pa.types.is_binary(array.type) else array.cast(wide)
    if not len(array):
        return
    null = np.asarray(array.is_null())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(array):
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), len(array))
        lo, hi = offsets[start], offsets[end]
        yield Slice(start, data[lo:hi], (offsets[start : end + 1] - lo).astype(np.int64), null[start:end])
        start = end


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHasher:
    """64-bit hashes of byte ranges of one flat array; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers(_MULTIPLIER, len(data)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; words don't cross rows."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return spans_where(inside[data], offsets)


def spans_where(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, cut where a row ends, and the row of each run."""
    n = len(inside)
    edge = np.empty(n + 1, bool)
    edge[0] = n > 0 and inside[0]
    edge[n] = n > 0 and inside[n - 1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n]) if n else None
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    places = np.flatnonzero(edge)
    if len(cut):
        places = np.sort(np.concatenate([places, cut, cut]), kind="stable")
    starts, ends = places[0::2], places[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
