"""Token files: ids in canonical length-limited Huffman codes, in independent blocks.

Format, version 1. A token file is a folder of two Parquet tables.

``codebook``: (token_id int, code_length int), one row for each id that occurs. Codes are canonical: sorted by
(code_length, token_id), numbered from 0, shifted left whenever the length grows. No code is longer than MAX_BITS, or than
one bit more than numbers of so many different ids need.

``blocks``: a row for each block of consecutive documents, at least BLOCK_TOKENS ids but for the last of a part:
part int (range of documents, ascending), block int (ascending in the part), part_start long (ids before it in the part),
n_null int (so many first documents have no id), doc_ids binary (int64 LE each, 0 for none), doc_tokens binary (uint32 LE each), checkpoints binary (uint32 LE: the bit at which
every EVERY-th id of the block begins, so lanes decode independently), payload binary (codes, first bit highest).

Blocks hold what they need to be decoded besides the codebook, so any block can be read alone, and Spark commits each
file once whichever executor wrote it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import document_columns, shared_dir, stored

MAX_BITS = 16
BLOCK_TOKENS = 1 << 16
EVERY = 128


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for symbols with the given counts > 0 (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels = []  # for each level: True where the merged list has a leaf, False where a package of the level below
    merged = leaves
    for _ in range(max_bits - 1):
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        merged = both[by]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Tables for coding and decoding, all made from (token_id, code_length)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        ids, lengths = ids[by], lengths[by]
        top = int(lengths.max(initial=1))
        first = (1 << (top - lengths)).astype(np.int64)
        left = np.cumsum(first) - first  # codes aligned to the longest
        size = int(ids.max(initial=0)) + 1
        self.bits = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.int64)
        self.bits[ids], self.code[ids] = lengths, left >> (top - lengths)
        self.top = top
        self.symbol = np.zeros(1 << top, np.uint32)
        self.used = np.ones(1 << top, np.int64)
        self.symbol[: first.sum()] = np.repeat(ids, first)
        self.used[: first.sum()] = np.repeat(lengths, first)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ids and the bit at which every EVERY-th begins."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        shifted = self.code[ids].astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint32)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted, heads)  # codes don't overlap, so sums are unions; only the last reaches the next word
        out[word[heads]] |= (sums >> np.uint64(32)).astype(np.uint32)
        out[word[heads] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::EVERY].astype("<u4")

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks (payload, checkpoints, number of ids), all lanes of all blocks at once."""
        buffer, lanes, left, base = [], [], [], 0
        for payload, checkpoints, n in blocks:
            buffer.append(payload + b"\0" * (8 - len(payload) % 4))
            lanes.append(checkpoints.astype(np.int64) + 8 * base)
            left.append(np.minimum(EVERY, n - EVERY * np.arange(len(checkpoints))))
            base += len(buffer[-1])
        at, left = np.concatenate(lanes), np.concatenate(left)
        words = np.frombuffer(b"".join(buffer), ">u4").astype(np.uint64)
        out = np.zeros((len(at), EVERY), np.uint32)
        mask = np.uint64((1 << self.top) - 1)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        for step in range(EVERY):
            live = int(np.searchsorted(-left, -step, "left"))
            if not live:
                break
            p = at[:live]
            word = p >> 5
            window = ((words[word] << np.uint64(32)) | words[word + 1]) >> (64 - self.top - (p & 31)).astype(np.uint64) & mask
            out[:live, step] = self.symbol[window]
            at[:live] += self.used[window]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out, result, row = out[back], [], 0
        for _, checkpoints, n in blocks:
            result.append(out[row : row + len(checkpoints)].reshape(-1)[:n])
            row += len(checkpoints)
        return result


def _raw_blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Blocks of plain ids: documents ranged by doc_id (null first), encoded in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        nulls = 0
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, nulls
            flat, n = np.concatenate(ids), np.concatenate(counts)
            row = [[part], [block], [start], [nulls], [np.concatenate(keys).astype("<i8").tobytes()], [n.astype("<u4").tobytes()], [flat.astype("<u4" if flat.max() > 0xFFFF else "<u2").tobytes()]]
            block, start, held, nulls = block + 1, start + len(flat), 0, 0
            keys.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "part_start", "n_null", "doc_ids", "doc_tokens", "ids"])

        for batch in batches:
            key, unnamed = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for rows, flat, begins in tokens.encoded(batch.column(1), tokenizer_path):
                first = 0
                while first < len(rows):  # cut at the document that fills the block
                    last = int(np.searchsorted(begins, begins[first] + BLOCK_TOKENS - held, "left"))
                    last = min(max(last, first + 1), len(rows))
                    keys.append(key[rows.first + first : rows.first + last])
                    nulls += int(unnamed[rows.first + first : rows.first + last].sum())
                    counts.append(np.diff(begins[first : last + 1]))
                    ids.append(flat[begins[first] : begins[last]])
                    held += int(begins[last] - begins[first])
                    first = last
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    ranged = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return ranged.mapInArrow(encode, "part int, block int, part_start long, n_null int, doc_ids binary, doc_tokens binary, ids binary")


def _plain_ids(row_ids: bytes, row_tokens: bytes) -> np.ndarray:
    n = int(np.frombuffer(row_tokens, "<u4").sum(dtype=np.int64))
    return np.frombuffer(row_ids, "<u4" if len(row_ids) == 4 * n else "<u2")


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text, each document's followed by the end id, as a token file at path in ascending id order.

    A null or empty text is the end id alone; a null id comes first; equal ids keep no order among themselves.
    An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    raw = shared_dir(spark)
    _raw_blocks(plain, tokenizer_path or tokens.default_path()).write.option("compression", "zstd").parquet(raw)
    blocks = spark.read.parquet(raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(_plain_ids(ids, n), minlength=len(total))
                own[: len(total)] += total
                total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token_id", "n"])

    # one row for each id of the vocabulary at most
    counted = blocks.select("ids", "doc_tokens").mapInArrow(count, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n")).orderBy("token_id").toPandas()
    ids, n = counted["token_id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    lengths = code_lengths(n, max(MAX_BITS, len(n).bit_length() + 1)) if len(n) else n
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "token_id int, code_length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(*book.value)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "ids"]
            coded = [codes.encode(_plain_ids(i, n)) for i, n in zip(batch.column("ids").to_pylist(), batch.column("doc_tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([c.tobytes() for _, c in coded], pa.binary()), pa.array([p for p, _ in coded], pa.binary())], names=[*names, "checkpoints", "payload"])

    blocks.mapInArrow(code, "part int, block int, part_start long, n_null int, doc_ids binary, doc_tokens binary, checkpoints binary, payload binary").write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: (doc_id, start, n_tokens, ids_crc32[, ids array<int>]) decoded from its blocks."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/codebook").collect()]  # bounded by the vocabulary
    sent = spark.sparkContext.broadcast((np.array([b[0] for b in book], np.int64), np.array([b[1] for b in book], np.int64)))
    ids_field = ", ids array<int>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(*sent.value)
        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for lo in range(0, batch.num_rows, 16):
                rows = range(lo, min(lo + 16, batch.num_rows))
                n_tokens = [np.frombuffer(column["doc_tokens"][r], "<u4").astype(np.int64) for r in rows]
                flats = codes.decode([(column["payload"][r], np.frombuffer(column["checkpoints"][r], "<u4"), int(n.sum())) for r, n in zip(rows, n_tokens, strict=True)])
                for r, n, flat in zip(rows, n_tokens, flats, strict=True):
                    ends = np.cumsum(n)
                    data = memoryview(flat.astype("<u4")).cast("B")
                    crc = [zlib.crc32(data[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                    keys = np.frombuffer(column["doc_ids"][r], "<i8")
                    out = [pa.array(keys, mask=np.arange(len(keys)) < column["n_null"][r]), pa.array(np.full(len(n), column["part"][r], np.int32)), pa.array(column["part_start"][r] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "part", "in_part", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return blocks.mapInArrow(decode, f"doc_id long, part int, in_part long, n_tokens long, ids_crc32 long{ids_field}")


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shift): ids in all parts before; one row for each part of the file."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["part", "n"])

    sums = spark.read.parquet(f"{path}/blocks").select("part", "doc_tokens").mapInArrow(total, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shift"))


def token_file(docs: DataFrame, *, path: str | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Writes documents as a token file, reads it back: (doc_id, start, n_tokens, ids_crc32[, ids]).

    start counts the ids of all documents before it in the file. A null or empty text is the end id alone; repeated rows are documents of their own, one after another; rows without id come
    first. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_tokens(docs, path, tokenizer_path=tokenizer_path, id_col=id_col, text_col=text_col)
    shifts = stored(token_starts(spark, path))
    documents = read_tokens(spark, path, with_ids=with_ids)
    return documents.join(F.broadcast(shifts), "part").select("doc_id", (F.col("in_part") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
