"""Language identification by prediction by partial matching.

For each language byte contexts of up to ORDER bytes form a tree with frozen counts. A byte costs -log2 of its probability in
the longest context that holds it, and of the escapes from the longer ones (escapes counted as distinct successors, probabilities of
shorter contexts without what the longer one has). The language with the shortest code for the whole text is predicted.

The contexts of all languages are one set of states, so that a text is walked once: the state at a byte follows from the last ORDER
bytes, and a table gives the cost of every byte in every state for every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import document_columns, fresh, lowered, slices, stored

ORDER = 3
#: Bounds of what is learned: labelled documents of each language (in the mean) and states.
TRAINING_DOCS = 1000
STATES = 3072
UNKNOWN = "und"
#: Texts with fewer bytes of letters than this are too short to be called strange.
LEAST_LETTERS = 100
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


@dataclass
class Trees:
    """languages; step[state, byte]: the next state; cost[language, state * 256 + byte]: bits; usual[language]: bits a byte of letters in its training texts."""

    languages: list[str]
    step: np.ndarray
    cost: np.ndarray
    usual: np.ndarray | None = None

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """state * 256 + byte for every byte of the rows (A-Z lowered)."""
        n = len(data)
        begins = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        byte = lowered(data).astype(np.int64)
        flat = self.step.reshape(-1)
        state = np.zeros(n, np.int64)  # before each byte; rows begin in the empty context
        for _ in range(ORDER):
            after = flat[(state << 8) | byte]
            state[1:] = after[:-1]
            state[begins] = 0
        return (state << 8) | byte

    def bits(self, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (rows x languages) of the walked rows in bits."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.languages)))
        full = np.flatnonzero(offsets[:-1] < offsets[1:])
        for k in range(len(self.languages)):
            out[full, k] = np.add.reduceat(self.cost[k][at], offsets[:-1][full], dtype=np.float64) if len(full) else 0
        return out

    def letters(self, at: np.ndarray, offsets: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits and bytes of the letters of each walked row in the language given for it; figures and signs tell nothing about a language."""
        letter = np.flatnonzero(_LETTER[at & 255])
        row = np.searchsorted(offsets, letter, "right") - 1
        n = len(offsets) - 1
        return np.bincount(row, self.cost[language[row], at[letter]], n), np.bincount(row, minlength=n)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, length, gram, n): byte runs of 1 to ORDER + 1 bytes within texts, counted per batch."""
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        out = []
        for part in slices(batch.column(1)):
            lang = langs[part.first : part.first + len(part)]
            data = lowered(part.data)
            position = np.arange(len(data)) - np.repeat(part.offsets[:-1], np.diff(part.offsets))
            names, which = np.unique(lang.astype(str), return_inverse=True)
            byte_lang = np.repeat(which, np.diff(part.offsets))
            gram = np.zeros(len(data), np.int64)
            for length in range(1, ORDER + 2):
                gram[length - 1 :] |= data[: len(data) - length + 1].astype(np.int64) << (8 * (length - 1))
                inside = position >= length - 1
                keys, n = np.unique((byte_lang[inside] << 40) | gram[inside], return_counts=True)
                out.append((names[keys >> 40], np.full(len(keys), length, np.int32), keys & ((1 << 40) - 1), n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]), pa.string()), *(pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2, 3))], names=["lang", "length", "gram", "n"])


def train(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", training_docs: int = TRAINING_DOCS, states: int = STATES) -> Trees:
    """Counts contexts in about training_docs documents of each language, chosen by a hash of their ids; whole texts of them, with A-Z lowered.

    Rows without language, id or text teach nothing. The states are those most counted, closed under leaving out
    bytes at either end.
    """
    sizes, chosen = _chosen(docs, lang_col, id_col, text_col, training_docs)
    grams = stored(chosen.select("lang", "text").mapInArrow(_grams, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")))
    best = grams.where(F.col("length") <= ORDER).groupBy("length", "gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length", "gram").limit(states - 1)
    contexts = {(int(r[0]), int(r[1])) for r in best.collect()}  # at most states rows
    for _ in range(ORDER):
        contexts = {(n, g) for n, g in contexts if n == 1 or ((n - 1, g >> 8) in contexts and (n - 1, g & ((1 << 8 * (n - 1)) - 1)) in contexts)}
    contexts = sorted(contexts)
    schema = "length int, context long"
    wanted = docs.sparkSession.createDataFrame([(n + 1, g) for n, g in [(0, 0), *contexts]], schema)
    counts = grams.withColumn("context", F.shiftright("gram", 8)).join(F.broadcast(wanted), ["length", "context"]).select("lang", "length", "context", (F.col("gram") % 256).alias("byte"), "n").toPandas()  # at most states x 256 rows a language
    return _tabulated(sorted(sizes), contexts, counts)


def _chosen(docs: DataFrame, lang_col: str, id_col: str, text_col: str, training_docs: int) -> tuple[dict[str, int], DataFrame]:
    """Documents of each language, and (lang, text) of those that are learned from."""
    plain = document_columns(docs, id_col, lang_col, text_col).toDF("doc_id", "lang", "text").dropna()
    sizes = {r[0]: r[1] for r in plain.select("doc_id", "lang").groupBy("lang").agg(F.count(F.lit(1))).collect()}  # one row per language
    if not sizes:
        return sizes, plain.select("lang", "text").limit(0)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, training_docs / n)))])
    return sizes, plain.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text")


def with_usual(docs: DataFrame, trees: Trees, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", training_docs: int = TRAINING_DOCS) -> Trees:
    """The trees with what a byte of letters takes in each language's own training texts, by which strange texts are told."""
    model, languages = docs.sparkSession.sparkContext.broadcast(trees), {n: k for k, n in enumerate(trees.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([languages[x] for x in batch.column(0).to_pylist()], np.int64)
            for part in slices(batch.column(1)):
                bits, n = model.value.letters(model.value.walk(part.data, part.offsets), part.offsets, own[part.first : part.first + len(part)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(bits), pa.array(n.astype(np.int64))], names=["lang", "bits", "n"])

    chosen = _chosen(docs, lang_col, id_col, text_col, training_docs)[1]
    sums = {r[0]: r[1] / max(r[2], 1) for r in chosen.mapInArrow(run, "lang string, bits double, n long").groupBy("lang").agg(F.sum("bits"), F.sum("n")).collect()}
    return replace(trees, usual=np.array([sums.get(n, 8.0) for n in trees.languages]))


def _tabulated(languages: list[str], contexts: list[tuple[int, int]], counts) -> Trees:  # noqa: ANN001
    number = {(0, 0): 0} | {c: i + 1 for i, c in enumerate(contexts)}
    n_states = len(number)
    step = np.zeros((n_states, 256), np.int16 if n_states < 1 << 15 else np.int32)
    for (n, g), i in number.items():
        for b in range(256):
            length, gram = n + 1, (g << 8) | b
            while length > ORDER or (length, gram) not in number:
                length -= 1
                gram &= (1 << 8 * length) - 1
            step[i, b] = number[length, gram]
    suffix = np.zeros(n_states, np.int64)
    for (n, g), i in number.items():
        if n:
            suffix[i] = number[n - 1, g & ((1 << 8 * (n - 1)) - 1)]
    cost = np.zeros((len(languages), n_states * 256), np.float32)
    at = np.fromiter((number[n - 1, g] for n, g in zip(counts["length"].tolist(), counts["context"].tolist(), strict=True)), np.int64, len(counts)) * 256 + counts["byte"].to_numpy(np.int64)
    lang = counts["lang"].to_numpy()
    for k, name in enumerate(languages):
        own = lang == name
        n = np.bincount(at[own], counts["n"].to_numpy(np.float64)[own], n_states * 256).reshape(n_states, 256)
        seen = n > 0
        total, kinds = n.sum(1, keepdims=True), seen.sum(1, keepdims=True).astype(np.float64)
        p = np.zeros((n_states, 256))
        for i in range(n_states):  # contexts stand in order of length, so the shorter are done
            lower = p[suffix[i]] if i else np.full(256, 1 / 256)
            if not total[i, 0]:
                p[i] = lower
                continue
            left = lower[~seen[i]].sum()
            escape = kinds[i, 0] / (total[i, 0] + kinds[i, 0]) if left > 1e-12 else 0.0
            p[i] = np.where(seen[i], n[i] / total[i, 0] * (1 - escape), escape * lower / max(left, 1e-12))
        cost[k] = -np.log2(np.maximum(p, 1e-12)).reshape(-1)
    return Trees(languages, step, cost)


def identify(docs: DataFrame, trees: Trees, *, text_col: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, lang_pred and score (0 to 1, the share of the predicted language when codes of an eighth of the bits count
    as probabilities), called as ``into`` says; a third name also gets how many times the usual bits of the predicted language a byte of the text's letters takes
    (needs with_usual; 0 for texts with fewer than LEAST_LETTERS bytes of letters). Columns of these names are replaced.

    A text that is null or has no letter is UNKNOWN with score 0; without learned languages every text is.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)
    docs = docs.drop(*into)
    flagged = docs.withColumn(fresh(docs.columns, "letter"), F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)))
    fields = [*docs.schema.fields, *[StructField(n, k) for n, k in zip(into, (StringType(), DoubleType(), DoubleType()), strict=False)]]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        known = np.array([*trees.languages, UNKNOWN], object)
        for batch in batches:
            which, score, rate = np.empty(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for part in slices(batch.column(names.index(text_col))):
                own = slice(part.first, part.first + len(part))
                if not trees.languages:
                    which[own] = 0
                    continue
                at = trees.walk(part.data, part.offsets)
                bits = trees.bits(at, part.offsets)
                which[own] = bits.argmin(1)
                least = bits.min(1)
                score[own] = 1 / np.exp2(-np.minimum((bits - least[:, None]) / 8, 1000)).sum(1)
                if len(into) > 2:
                    spent, n = trees.letters(at, part.offsets, which[own])
                    rate[own] = np.where(n >= LEAST_LETTERS, spent / np.maximum(n, 1) / np.maximum(trees.usual[which[own]], 1e-9), 0)
            silent = ~np.asarray(batch.column(len(names)).to_numpy(zero_copy_only=False), bool)
            which[silent], score[silent] = len(trees.languages), 0.0
            more = [pa.array(rate)] if len(into) > 2 else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(known[which], pa.string()), pa.array(score), *more], names=[f.name for f in fields])

    return flagged.mapInArrow(run, StructType(fields))


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents that aren't held out, predicts all.

    Repeated rows are predicted each. An empty table gives an empty result.
    """
    trees = train(docs.where(~held_out(id_col)), lang_col=lang_col, id_col=id_col, text_col=text_col)
    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text")
    return identify(plain, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


