"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and, of longer words, their first PREFIX bytes, hashed to BUCKETS. The machine is
w0 + sum of w over terms + sum over pairs of terms of the product of their factors, divided by the number of terms, so that two terms may mean
together what neither means alone. All terms that aren't rare go into it, whatever they tell by themselves: weights are fitted with a penalty
that keeps those of noise at zero, factors with a decay. It is fitted on a bounded sample of labelled rows and then scores every text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import SpanHasher, document_columns, lowered, slices, spans_where, stored

BUCKETS = 1 << 20
PREFIX = 5
#: Bounds of the sample that the machine is fitted on: labelled rows, and (row, term) entries in all of them.
TRAINING_ROWS, TRAINING_TERMS = 20_000, 1 << 24
#: So many rows of the rarer label are in the sample at least (if there are so many; at most half of it).
LEAST_OF_LABEL = 1000
#: A term is known to the machine if it stands in so many rows of the sample.
LEAST_ROWS = 8
FACTORS = 4

_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def hashed_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all terms, distinct per row, ascending."""
    low = lowered(data)
    starts, ends, row = spans_where(_INSIDE[low], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher = SpanHasher(low)
    words = hasher.spans(starts, ends) % np.uint64(BUCKETS)
    long = np.flatnonzero(ends - starts > PREFIX)
    fronts = (hasher.spans(starts[long], starts[long] + PREFIX) ^ np.uint64(0x5BF03635)) % np.uint64(BUCKETS)
    key = np.concatenate([row * BUCKETS + words.astype(np.int64), row[long] * BUCKETS + fronts.astype(np.int64)])
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


@dataclass
class Machine:
    """Weights and factors by place; place[bucket] is 0 for terms that aren't known, whose weights are 0."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of rows given as (row, bucket) of their terms."""
        at = self.place[bucket]
        known = at > 0
        row, at = row[known], at[known]
        pairs = np.zeros(rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f].astype(np.float64)
            pairs += np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows)
        return self.bias + np.bincount(row, self.weights[at], rows) + 0.5 * pairs / np.maximum(np.bincount(row, minlength=rows), 1)


def fit(begins: np.ndarray, places: np.ndarray, labels: np.ndarray, terms: np.ndarray, *, factors: int = FACTORS, epochs: int = 10, steps: int = 400, rate: float = 0.3, penalty: float = 16.0, pair_rate: float = 0.5, decay: float = 1e-3, batch: int = 256, seed: int = 11) -> Machine:
    """Fits on rows (row i holds places[begins[i]:begins[i + 1]], from 1, of terms) by steps of the logistic loss.

    Weights follow the regularised leader: one whose gradients don't add up beyond the penalty is zero, as are those of most terms. Factors begin at
    random and take adaptive steps; what no pair holds up decays. Small samples get smaller batches, more epochs (until there are ``steps`` of them) and a smaller penalty.
    """
    batch, penalty = min(batch, max(16, len(labels) // 16)), min(penalty, len(labels) ** 0.5 / 4)
    epochs = max(epochs, -(-steps * batch // max(len(labels), 1)))
    random = np.random.default_rng(seed)
    n = len(terms) + 1
    w, v = np.zeros(n), random.normal(0, 0.1, (n, factors)).astype(np.float32)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    place = np.zeros(BUCKETS, np.int32)
    place[terms] = np.arange(1, n)
    if not len(labels) or labels.min() == labels.max():
        return Machine(bias, place, w, np.zeros_like(v))
    pull, w_seen, v_seen, bias_seen, sizes = np.zeros(n), np.zeros(n), np.full((n, factors), 1e-8, np.float32), 1e-8, np.diff(begins)
    for _ in range(epochs):
        for chosen in np.array_split(random.permutation(len(labels)), max(1, len(labels) // batch)):
            at = np.concatenate([places[begins[i] : begins[i + 1]] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes[chosen])
            scale = (1 / np.sqrt(np.maximum(sizes[chosen], 1)))[row]
            used, which = np.unique(at, return_inverse=True)
            own = v[at] * scale[:, None]
            total = np.stack([np.bincount(row, own[:, f], len(chosen)) for f in range(factors)], 1)
            logit = bias + np.bincount(row, w[at], len(chosen)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (own**2).sum(1), len(chosen)))
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]
            gradient = np.bincount(which, error[row], len(used))
            seen = w_seen[used] + gradient**2
            pull[used] += gradient - (np.sqrt(seen) - np.sqrt(w_seen[used])) / rate * w[used]
            w_seen[used] = seen
            over = np.maximum(np.abs(pull[used]) - penalty, 0) * np.sign(pull[used])
            w[used] = -over / ((1 + np.sqrt(seen)) / rate + 0.1)
            error /= len(chosen)
            pulls = (error[row] * scale)[:, None] * (total[row] - own)
            v_gradient = np.stack([np.bincount(which, pulls[:, f], len(used)) for f in range(factors)], 1) + decay * v[used]
            v_seen[used] += v_gradient**2
            v[used] -= pair_rate * v_gradient / np.sqrt(v_seen[used])
            bias_seen += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(bias_seen)
    return Machine(bias, place, w, v)


def held_out(id_col: str = "doc_id", fifth: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fifth == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS, training_terms: int = TRAINING_TERMS) -> Machine:
    """Fits the machine on at most training_rows labelled documents: those of the smallest hashes of their ids, of each label as many as its share of all
    labelled ids, but of the rarer one at least LEAST_OF_LABEL.

    Rows without id or label are left out; of several labels of one id the largest counts, and is 1 if above 0. Where the rarer label has more than its share, the bias
    is set back to it. Of texts so long that the sample would hold more than training_terms different terms of its rows, fewer are taken. Without any row of
    either label the score is the same for all texts.
    """
    own = document_columns(labels, id_col, label_col).toDF("label_id", "label").dropna()
    own = stored(own.groupBy("label_id").agg((F.max("label") > 0).cast("int").alias("label")))
    shares = {r[0]: r[1] for r in own.groupBy("label").agg(F.count(F.lit(1))).collect()}  # two rows at most
    rare = 1 if shares.get(1, 0) <= shares.get(0, 0) else 0
    of_rare = max(round(training_rows * shares.get(rare, 0) / max(sum(shares.values()), 1)), min(LEAST_OF_LABEL, training_rows // 2))
    quota = {rare: of_rare, 1 - rare: training_rows - of_rare}
    first = [own.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(quota[value]) for value in (0, 1)]
    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text")
    sample = F.broadcast(first[0].union(first[1]))  # at most training_rows rows
    rows = plain.join(sample, F.col("doc_id") == F.col("label_id")).select(F.xxhash64("label_id").alias("key"), "label", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                row, bucket = hashed_terms(part.data, part.offsets)
                begins = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                own = slice(part.first, part.first + len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], batch.column(1)[own], pa.ListArray.from_arrays(pa.array(begins), pa.array(bucket.astype(np.int32)))], names=["key", "label", "terms"])

    hashed = stored(rows.mapInArrow(terms, "key long, label int, terms array<int>"))
    entries = hashed.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()[0]
    if entries > training_terms:  # keys are spread evenly, so this leaves about so many of the entries
        hashed = hashed.where(F.pmod("key", F.lit(1 << 20)) < int(training_terms / entries * (1 << 20)))
    counts = hashed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    chosen = np.sort(counts.where(F.col("n") >= LEAST_ROWS).toPandas()["term"].to_numpy(np.int64))  # at most BUCKETS numbers
    place = np.zeros(BUCKETS, np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)
    keep = hashed.sparkSession.sparkContext.broadcast(place)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            begins = np.asarray(column.offsets)
            at = keep.value[np.asarray(column.values)[begins[0] : begins[-1]]]
            upto = np.concatenate([[0], np.cumsum(at > 0)])[begins - begins[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(upto), pa.array(at[at > 0]))], names=["key", "label", "terms"])

    table = hashed.mapInArrow(kept, "key long, label int, terms array<int>").toArrow()  # at most training_rows rows of about training_terms places together
    keep.unpersist()
    column = table.column("terms").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    begins, places = np.asarray(column.offsets), np.asarray(column.values)
    sizes, key, label = np.diff(begins), table.column("key").to_numpy(), table.column("label").to_numpy().astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(places, dtype=np.int64)])[begins]
    order = np.lexsort([label, np.diff(sums), sizes, key])  # the same whichever task came first
    starts = np.cumsum(sizes[order]) - sizes[order]
    if len(order):
        places = places[np.repeat(begins[:-1][order] - starts, sizes[order]) + np.arange(len(places))]
    machine = fit(np.append(starts, len(places)), places, label[order], chosen)
    if len(shares) == 2 and len(label) and 0 < label.mean() < 1:
        machine.bias += float(np.log(shares[1] / shares[0]) - np.log(label.mean() / (1 - label.mean())))
    return machine


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs and the score of each whole text (0 to 1); null and empty texts score as a text without terms.

    A column that is called as the score is replaced.
    """
    docs = docs.drop(into)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for part in slices(batch.column(batch.schema.get_field_index(text_col))):
                row, bucket = hashed_terms(part.data, part.offsets)
                logit = model.value.logits(row, bucket, len(part))
                out[part.first : part.first + len(part)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from rows that aren't held out, scores all documents.

    Empty tables of documents give an empty result; without usable labels every score is the same, near 0.
    """
    machine = train(docs, labels.where(~held_out(id_col)), label_col=label_col, id_col=id_col, text_col=text_col)
    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text")
    scored = score(plain, machine).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
