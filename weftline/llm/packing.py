"""Best-fit packing of documents into sequences by exact-complement hashing.

Packing needs only how many pieces there are of each length, a table of as many rows as a sequence has tokens
whatever the corpus. On it the plan is made: an index holds the single lengths, pairs and triples of available lengths by
their sums, a combination that fills a gap exactly is used as often as its counts allow, and what has no
exact complement is filled by best fit. The plan is a list of patterns with multiplicities; each piece finds its place in
it by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import document_columns, numbered, stored

#: Pieces of one length are ranked in parts of about so many, so that a length that many pieces share is not one task.
RANK_ROWS = 1 << 17


class SumIndex:
    """Single lengths, pairs and triples of lengths by their sums; what counts no longer allow is taken out when it is met.

    pairs[s] holds the longer lengths a of pairs a + (s - a), triples[s] the longest of triples, ascending, so that the longest stands at the end. Triples are listed
    for a sum when it is first asked for, from the pairs of what is left beside each length.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.lengths = sorted(counts)
        self.pairs: dict[int, list[int]] = {}
        for a in self.lengths:
            for b in self.lengths:
                if b > a or a + b > capacity:
                    break
                self.pairs.setdefault(a + b, []).append(a)
        self.triples: dict[int, list[int]] = {}

    def single(self, gap: int, free: np.ndarray) -> tuple[int, ...] | None:
        return (gap,) if free[gap] > 0 else None

    def pair(self, gap: int, free: np.ndarray, most: int | None = None) -> tuple[int, ...] | None:
        """The pair of this sum with the longest length (of at most ``most``) that is free."""
        for a in reversed(self.pairs.get(gap, ())):
            b = gap - a
            if (most is None or a <= most) and free[a] > 0 and free[b] > (a == b):
                return a, b
        return None

    def triple(self, gap: int, free: np.ndarray) -> tuple[int, ...] | None:
        if gap not in self.triples:
            self.triples[gap] = [a for a in self.lengths if a < gap <= 3 * a and gap - a in self.pairs]
        for a in reversed(self.triples[gap]):
            if free[a] > 0:
                free[a] -= 1
                rest = self.pair(gap - a, free, most=a)
                free[a] += 1
                if rest:
                    return a, *rest
        return None

    def spent(self, gaps: list[int], length: int) -> None:
        """Takes a length without pieces out of the lists of these sums."""
        for gap in gaps:
            for index in (self.pairs, self.triples):
                if length in (own := index.get(gap, [])):
                    own.remove(length)


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use up counts (length: pieces), no pattern longer than capacity."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    plan, index = [], SumIndex({x: n for x, n in counts.items() if n > 0}, capacity)
    while len(lengths := np.flatnonzero(free)):
        pattern, gap, left = [], capacity, free.copy()
        x = int(lengths[-1])
        while True:
            pattern.append(x)
            left[x] -= 1
            gap -= x
            if not gap:
                break
            exact = index.single(gap, left) or index.pair(gap, left) or index.triple(gap, left)
            if exact:
                pattern += exact
                break
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            x = int(fits[-1])
        uses = Counter(pattern)
        times = min(int(free[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            free[x] -= times * n
            if not free[x]:
                index.spent([x + y for y in index.lengths if x + y <= capacity], x)
        plan.append((tuple(sorted(pattern, reverse=True)), times))
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length in it: length, first and past-the-last rank, pieces a sequence, first sequence, offset."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length, n in Counter(pattern).items():
            rows.append((length, rank[length], rank[length] + n * times, n, sequence, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to capacity tokens (a stored table with a column row_no).

    Equal lengths are told apart by row_no. No rows give no rows.
    """
    spark = pieces.sparkSession
    length = F.col(length_col)
    parts = max(256, -(-pieces.count() // RANK_ROWS))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int"))
    by_part = stored(parted.groupBy(length.alias("length_"), "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in by_part.groupBy("length_").agg(F.sum("n")).collect()}  # at most capacity rows
    places = spark.createDataFrame(_places(packing_plan(counts, capacity)), "length_ int, low long, past long, each int, sequence long, place long")
    before = Window.partitionBy("length_").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("length_", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy(length_col, "part").orderBy("row_no")
    ranked = parted.withColumn("rank_in", F.row_number().over(within) - 1).join(shifts, (length == F.col("length_")) & (parted["part"] == shifts["part"])).drop("length_", "part")
    ranked = ranked.withColumn("rank_", F.col("rank_in") + F.col("shift")).drop("rank_in", "shift")
    # places has a few rows for each of at most capacity lengths, whatever the input
    at = (length == F.col("length_")) & (F.col("rank_") >= F.col("low")) & (F.col("rank_") < F.col("past"))
    k = F.col("rank_") - F.col("low")
    placed = ranked.join(F.broadcast(places), at)
    return placed.withColumn("sequence_id", F.col("sequence") + F.floor(k / F.col("each"))).withColumn("offset", (F.col("place") + (k % F.col("each")) * length).cast("long")).drop("length_", "low", "past", "each", "sequence", "place", "rank_")


def token_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity ids (doc_id, piece, start, length, ids_crc32); only longer documents are cut, the first piece then takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, begins in tokens.encoded(batch.column(1), tokenizer_path):
                lengths = np.diff(begins)
                n_pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(rows)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                remainder = (lengths - 1) % capacity + 1
                start = np.where(piece == 0, 0, remainder[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, remainder[row], capacity)
                data = memoryview(ids.astype("<u4")).cast("B")
                at = 4 * (begins[row] + start)
                crc = np.fromiter((zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.first, len(rows)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, *, capacity: int = 1024, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs token ids of all documents, each followed by the end id, into few sequences of at most capacity.

    Row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is the end id
    alone. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    pieces = numbered(token_pieces(docs, capacity, tokenizer_path or tokens.default_path(), id_col, text_col))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
