"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document is the set of its distinct word shingles, kept as 64-bit hashes. SuperMinHash draws for every element a
permutation of the signature's places and gives place p[j] the value j + u[j]; the signature is the minimum over elements,
place by place. Values of one element are spread over the places instead of being independent, which lowers the variance, and no
element needs to be followed beyond the largest value that its document's signature still holds.

Documents of equal sets are one class. Signatures of classes are cut into bands; classes that agree in a band are candidates. In each
bucket all are held against one of them on their full sets, in a few rounds; linked classes are grouped by union-find each time. Then
classes that still share a bucket without sharing a group are held against each other as far as the rarest elements of their sets
leave it possible, which is exact. So a group of thousands of near copies costs a few comparisons for each member, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, SpanHasher, document_columns, lowered, mixed, numbered, sendable, shared_dir, slices, stored, word_spans


#: So often the classes of a bucket are held against one of them: first against the smallest, then against others by a hash.
STAR_ROUNDS = 3


@dataclass(frozen=True)
class Settings:
    """words in a shingle; links at intersection / union >= percent / 100; bands of rows_in_band places each.

    A pair at the threshold of 0.8 agrees in none of 24 bands of 4 with a chance below 4 in a million.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows_in_band: int = 4

    @property
    def places(self) -> int:
        return self.bands * self.rows_in_band


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (row, hash) in ascending order of both; a row of fewer words has their whole sequence as one."""
    low = lowered(data)
    starts, ends, row = word_spans(low, offsets, SPACES)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = SpanHasher(low).spans(starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    length = np.minimum(n[row], words)
    begins = np.flatnonzero(place + length <= n[row])
    begins = begins[(n[row[begins]] >= words) | (place[begins] == 0)]
    value = np.full(len(begins), 0x243F6A8885A308D3, np.uint64) + length[begins].astype(np.uint64)
    for k in range(words):
        inside = k < length[begins]
        value[inside] = mixed(value[inside] * np.uint64(0x9E3779B97F4A7C15) + word[begins[inside] + k])
    rows = row[begins]
    by = np.lexsort((value, rows))
    rows, value = rows[by], value[by]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    return rows[new], value[new]


def super_minhash(row: np.ndarray, element: np.ndarray, n_rows: int, places: int, step: int = 1 << 15) -> np.ndarray:
    """Signatures (n_rows x places) of sets given as (row, element); 64-bit values: the rank j, then 56 bits of u[j].

    A row without elements has the largest value everywhere.
    """
    signature = np.full((n_rows, places), np.iinfo(np.uint64).max, np.uint64)
    bounds = np.append(np.arange(0, len(row), step), len(row))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own_row, seed = row[lo:hi], element[lo:hi]
        order = None  # the places in the order drawn so far, a line for each element
        for j in range(places):
            draw = mixed(seed + np.uint64(((2 * j + 1) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
            u = (draw >> np.uint64(8)) | np.uint64(j << 56)
            k = j + (mixed(draw ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.int64) * (places - j) // (1 << 32)
            if order is None:
                at = k
            else:
                line = np.arange(len(k))
                at = order[line, k].astype(np.int64)
                order[line, k] = order[:, j]
            np.minimum.at(signature.reshape(-1), own_row * places + at, u)
            worst = signature[own_row[0] : own_row[-1] + 1].max(axis=1)
            active = worst[own_row - own_row[0]] >= np.uint64((j + 1) << 56)
            if not active.any():
                break
            if order is None:
                order = np.broadcast_to(np.arange(places, dtype=np.uint16), (int(active.sum()), places)).copy()
                order[np.arange(len(order)), k[active]] = 0
            else:
                order = order[active]
            own_row, seed = own_row[active], seed[active]
    return signature


def _sketch_schema(id_type: str) -> str:
    return f"row_no long, doc_id {id_type}, n_shingles long, digest binary, bands array<long>"


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row_no, doc_id, n_shingles, digest, bands) of rows (row_no, doc_id, text); without shingles digest and the rest are null.

    digest names the set (16 bytes of its hashes' blake2b), bands holds a hash per band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                row, value = shingles(part.data, part.offsets, settings.words)
                n = np.bincount(row, minlength=len(part))
                ends = np.cumsum(n)
                raw = memoryview(value.astype("<u8")).cast("B")
                digest = [hashlib.blake2b(raw[8 * (e - m) : 8 * e], digest_size=16).digest() if m else None for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                signature = super_minhash(row, value, len(part), settings.places)
                band = signature.reshape(len(part), settings.bands, settings.rows_in_band)
                key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), band.shape[:2]).copy()
                for k in range(settings.rows_in_band):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + band[:, :, k])
                bands = pa.ListArray.from_arrays(pa.array((np.arange(len(part) + 1) * settings.bands).astype(np.int32)), pa.array(key.view(np.int64).reshape(-1)))
                own = slice(part.first, part.first + len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], batch.column(1)[own], pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), bands], names=["row_no", "doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, _sketch_schema(docs.schema["doc_id"].dataType.simpleString()))


def _full_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(class, set binary): sorted 64-bit shingle hashes of the wanted documents (row_no), whose class is row_no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, value = shingles(part.data, part.offsets, settings.words)
                ends = np.searchsorted(row, np.arange(len(part)), "right").tolist()
                raw = value.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array([raw[8 * a : 8 * b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], names=["class", "set"])

    return docs.join(sendable(wanted), docs["row_no"] == wanted["class"], "left_semi").select("row_no", "text").mapInArrow(run, "class long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of (a, b) whose full sets are similar enough."""
    percent = settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * same >= percent * (len(x) + len(y) - same)
            kept = batch.filter(pa.array(good))
            yield kept.select(["a", "b"])

    left = sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    right = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


CELLS = 64


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a set's elements by cell; null where one doesn't fit a short."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
        counts = [np.bincount(((x >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.astype(np.int16) if c.max() < 1 << 15 else None for c in counts], pa.list_(pa.int16()))], names=["class", "cells"])


def _prefix_candidates(open_sets: DataFrame, settings: Settings, folder: str) -> DataFrame:
    """Pairs (a, b) of classes of different groups whose sets may still be similar enough, of rows (class, root, set).

    With elements in one order, rare ones first, sets that are similar enough share one of their first few, and from the place of the
    first that they share on enough must be left. Beside that, elements are counted in CELLS cells by their hash: no more are shared
    than the smaller counts add up to. So what many documents share makes few pairs, and no similar pair is lost.
    """
    percent = settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray([len(x.as_buffer()) // 8 for x in batch.column(2)], np.int64)
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8")
            row = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(lengths, lengths)), pa.array(flat)], names=["class", "root", "n", "element"])

    elements = open_sets.select("class", "root", "set").mapInArrow(run, "class long, root long, n long, element long")
    spread = elements.groupBy("element").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("df > 1")
    ranked = elements.join(spread, "element", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "element"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = stored(ranked.withColumn("place", place).where((F.col("place") <= most) & (F.col("low") < F.col("high"))).select("class", "root", "n", "element", "place"), f"{folder}/prefixes")
    cells = stored(open_sets.select("class", "set").mapInArrow(_cells, "class long, cells array<short>"), f"{folder}/cells")
    first = first.join(sendable(cells, 50_000), "class")
    x, y = first.alias("x"), first.alias("y")
    fits = F.lit(100) * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    shared = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    enough = shared * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    meet = F.aggregate(F.zip_with("x.cells", "y.cells", lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n.cast("int"))
    common = F.coalesce(meet * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")), F.lit(True))
    pairs = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & fits & enough & common)
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(class, root) for all classes of edges (a, b): the smallest class that each can reach.

    Union-find by rounds: every root hooks to the smallest root that an edge of its tree leads to, then paths are halved until all
    point at roots. In a round every tree but those smaller than all their neighbours joins another; each round is written to folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    roots = stored(both.groupBy(F.col("a").alias("class")).agg(F.least(F.col("class"), F.min("b")).alias("root")), f"{folder}/roots-0")
    turn = 0
    while True:
        turn += 1
        # short cuts: a class takes its root's root
        up = roots.select(F.col("class").alias("root"), F.col("root").alias("above"))
        moved = stored(roots.join(up, "root").select("class", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("changed")), f"{folder}/up-{turn}")
        if moved.where("changed").limit(1).count():
            roots = moved.drop("changed")
            continue
        flat = moved.drop("changed")
        ends = edges.join(flat.select(F.col("class").alias("a"), F.col("root").alias("ra")), "a").join(flat.select(F.col("class").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        hooks = stored(ends.groupBy(F.greatest("ra", "rb").alias("class")).agg(F.min(F.least("ra", "rb")).alias("hook")), f"{folder}/hooks-{turn}")
        if not hooks.limit(1).count():
            return flat
        roots = stored(flat.join(hooks, "class", "left").select("class", F.coalesce("hook", "root").alias("root")), f"{folder}/roots-{turn}")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id, kept, class_id, row_no, root) for every row.

    component_id is the smallest doc_id that links reach, kept marks it. class_id is the smallest doc_id of the same set;
    row_no numbers the rows, root is the smallest row_no of the component. Null, empty and wordless texts have no shingles and are linked with
    nothing. Of repeated rows of one doc_id every one is returned, and kept where the component has that id. Rows of null doc_id come after all
    others. row_col: a column of docs with a number for each row, stored in it; without it docs is stored once with numbers. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    if row_col:
        plain = document_columns(docs, id_col, text_col, row_col).toDF("doc_id", "text", "row_no")
    else:
        plain = numbered(document_columns(docs, id_col, text_col).toDF("doc_id", "text"), path=f"{folder}/rows")
    rows = stored(sketches(plain.select("row_no", "doc_id", "text"), settings), f"{folder}/sketches")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("row_no").alias("class"))
    # of each class one row stands for all; the others' signatures are the same
    heads = stored(rows.join(classes, rows["row_no"] == classes["class"], "left_semi").withColumnRenamed("row_no", "class"), f"{folder}/heads")
    member = rows.select("row_no", "digest").where("digest is not null").join(heads.select("digest", "class"), "digest").select("row_no", "class")

    buckets = heads.select("class", "n_shingles", F.explode("bands").alias("band"))
    crowded = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    shared = stored(buckets.join(crowded, "band").select("band", "class", "n_shingles"), f"{folder}/buckets")
    # every class that shares a bucket may be asked for its set in any round
    wanted = stored(shared.select("class").distinct(), f"{folder}/wanted")
    sets = stored(_full_sets(plain, wanted, settings), f"{folder}/sets")

    grouped, tested, links = shared.withColumn("root", F.col("class")), None, None
    for turn in range(STAR_ROUNDS):
        order = F.col("class") if turn == 0 else F.xxhash64("class", F.lit(turn))
        head = F.min_by(F.struct("class", "root", "n_shingles"), order).alias("head")
        leaders = grouped.groupBy("band").agg(head, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "head")
        fits = F.lit(100) * F.least("head.n_shingles", "n_shingles") >= settings.percent * F.greatest("head.n_shingles", "n_shingles")
        pairs = grouped.join(leaders, "band").where((F.col("root") != F.col("head.root")) & fits).select(F.least("class", "head.class").alias("a"), F.greatest("class", "head.class").alias("b")).distinct()
        stars = stored(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, f"{folder}/stars-{turn}")
        found = stored(_verified(stars, sets, settings), f"{folder}/links-{turn}")
        tested, links = (tested.union(stars), links.union(found)) if turn else (stars, found)
        groups = components(links, f"{folder}/groups-{turn}")
        grouped = stored(shared.join(groups, "class", "left").select("band", "class", "n_shingles", F.coalesce("root", "class").alias("root")), f"{folder}/grouped-{turn}")

    mixed_buckets = grouped.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    open_classes = stored(grouped.join(mixed_buckets, "band").select("class", "root").distinct(), f"{folder}/open")
    rest = _prefix_candidates(open_classes.join(sets, "class"), settings, folder)
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), f"{folder}/rest")
    more = stored(_verified(rest, sets, settings), f"{folder}/more")
    groups = components(links.union(more), f"{folder}/all-groups") if more.limit(1).count() else groups

    named = member.join(groups, "class", "left").select("row_no", "class", F.coalesce("root", "class").alias("root"))
    ids = rows.select("row_no", "doc_id", "n_shingles").join(named, "row_no", "left").withColumn("root", F.coalesce("root", "row_no")).withColumn("class", F.coalesce("class", "row_no"))
    ids = stored(ids, f"{folder}/ids")
    # stored, so that the joins shuffle rows and results apart and a group of many rows may be split among tasks
    least = stored(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")), f"{folder}/least")
    least_of_class = stored(ids.groupBy("class").agg(F.min("doc_id").alias("class_id")), f"{folder}/least-of-class")
    return ids.join(least, "root").join(least_of_class, "class").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id", "row_no", "root")
