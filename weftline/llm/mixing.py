"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, where u is drawn from its id and w is its quality weight. Within a
source documents are taken in the order of their keys until the source's budget of words is spent, so that
heavier documents tend to come first. A target beyond a source's size takes whole epochs of all its documents
first and spends what remains by the keys.

The order is never built in one task: documents are counted into slots of the key, the slots are summed up per
source, and only the one slot in which a budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, document_columns, row_id, stored

#: Slots of the key in a source. The slot in which a budget ends holds about one part in SLOTS of its source.
SLOTS = 1 << 16
#: Rows whose numbers differ in so many last bits are ranked together.
OCCURRENCE_BITS = 12
#: No more epochs than this of any source.
MAX_EPOCHS = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Weight from 0.05 to 1: the share of characters that are neither digits nor ASCII punctuation."""
    plain = F.translate(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    share = F.length(plain) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(share, F.lit(0.05)), F.lit(0.05)).cast("double")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of md5(seed:key); the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_occurrence(rows: DataFrame, digest: str, row_no: str, into: str) -> DataFrame:
    """Stored rows with the number of each among those of its digest, from 0, in the order of row_no.

    Rows are ranked among those of equal row_no >> OCCURRENCE_BITS, which are few, and these groups are summed up, so a digest of many rows is many tasks.
    """
    group = F.shiftright(F.col(row_no), OCCURRENCE_BITS)
    grouped = rows.withColumn("group_", group)
    sizes = grouped.groupBy(digest, "group_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(digest).orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(digest).alias("digest_"), F.col("group_").alias("group_of"), before.alias("before_"))
    ranked = grouped.withColumn("in_", F.row_number().over(Window.partitionBy(digest, "group_").orderBy(row_no)) - 1)
    joined = ranked.join(starts, (F.col(digest) == F.col("digest_")) & (F.col("group_") == F.col("group_of")))
    return joined.withColumn(into, (F.col("before_") + F.col("in_")).cast("long")).drop("group_", "in_", "before_", "digest_", "group_of")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """Targets of sources (source, source_size): share x all words by weight, none above MAX_EPOCHS x its size.

    Sources ordered by code point, null last, take the weights in turn. The excess of full sources goes to the
    others by weight: with sources in the order of size / weight, the full ones are the first few, and
    each is full exactly if the level left by those before it reaches it. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("most", F.lit(MAX_EPOCHS) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    full = F.col("most") <= F.col("level") * F.col("weight")
    last = F.min(F.when(~full, F.col("level"))).over(everything)  # the level of the first that isn't full; after it levels only rise
    first_open = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(full, F.col("most")).otherwise(F.coalesce(first_open, last) * F.col("weight"))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, row_col: str | None = None,
) -> DataFrame:
    """How often a mix takes each document: row (doc_id, source, size, source_size, target, epochs, copies, taken).

    size counts words of the text, ``taken`` is copies x size. Documents are taken by their keys while they fit the
    budget; of those left, the one whose size comes nearest to what is missing is taken too. Ties of the key go by doc_id, null last; repeated rows are
    documents of their own. A row without id draws by a hash of its source and text and by its number among equal such rows, so that reruns agree however the
    table is read: which of equal rows is taken can't be told. Null and empty texts have size 0, are in every whole epoch and never hold up a budget;
    a source whose documents are all empty has target 0. Null sources are one source, the last.
    row_col: a column with a number for each row, stored in docs, to be given as row_no. An empty table gives an empty result.
    """
    text = F.col(text_col)
    plain = document_columns(docs, id_col, text_col, source_col, *([row_col] if row_col else []))
    number = F.col(row_col) if row_col else row_id()
    id_, source = F.col(id_col), F.col(source_col).cast("string")
    unnamed = F.sha2(F.concat(F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), F.sha2(source, 256))), F.when(text.isNull(), "n").otherwise(F.concat(F.lit("t"), F.sha2(text, 256)))), 256)
    columns = [id_.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), text_quality(text).alias("quality"), number.alias("row_no"), F.when(id_.isNull(), unnamed).alias("digest")]
    narrow = stored(plain.select(*columns))
    keyed, nameless = narrow.where("doc_id is not null").withColumn("name", F.col("doc_id").cast("string")), narrow.where("doc_id is null")
    if not nameless.isEmpty():
        counted = with_occurrence(nameless, "digest", "row_no", "occurrence")
        keyed = stored(keyed.unionByName(counted.withColumn("name", F.concat_ws(" ", F.lit("row"), "digest", "occurrence")).drop("occurrence")))
    narrow = keyed.withColumn("key", -F.log(uniform(F.col("name"), seed)) / F.col("quality")).drop("name", "digest", "quality")
    # 1 - exp(-key) rises with the key from 0 to 1
    slotted = narrow.withColumn("slot", F.least(F.floor((1 - F.exp(-F.col("key"))) * slots), F.lit(slots - 1)).cast("int"))

    by_slot = stored(slotted.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")))
    targets = stored(source_targets(by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", whole).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    same_source = F.col("t.source").eqNullSafe(F.col("s.source"))
    running = Window.partitionBy("s.source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = by_slot.alias("s").join(targets.alias("t"), same_source).select("s.source", "slot", "slot_size", "budget", F.sum("slot_size").over(running).alias("upto"))
    ends = ends.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("slot_size") < F.col("budget")))
    ends = ends.groupBy("source").agg(F.min(F.struct("slot", (F.col("upto") - F.col("slot_size")).alias("before"))).alias("end"))
    bounds = stored(targets.alias("t").join(ends.alias("s"), same_source, "left").select("t.*", F.col("end.slot").alias("end_slot"), F.col("end.before").alias("before")))

    # one row per source: small enough to be sent along by its measured size, or joined by the optimizer otherwise
    joined = slotted.alias("s").join(bounds.alias("t"), same_source).select("doc_id", "s.source", "size", "key", "slot", "row_no", "source_size", "target", "epochs", "budget", "end_slot", "before")
    at_end = F.col("slot") == F.col("end_slot")
    sure = joined.where(F.coalesce(~at_end, F.lit(True))).withColumn("extra", F.coalesce(F.col("slot") < F.col("end_slot"), F.lit(False)).cast("int"))
    order = Window.partitionBy("source", "slot").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = joined.where(at_end).withColumn("extra", (F.col("before") + F.sum("size").over(order) <= F.col("budget")).cast("int"))
    decided = stored(sure.unionByName(split).drop("slot", "end_slot", "before"))

    gaps = decided.groupBy("source").agg((F.first("budget") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    closest = decided.alias("s").where("extra = 0").join(gaps.alias("t"), same_source).where(off < F.col("gap"))
    closest = closest.groupBy("s.source").agg(F.min(F.struct(off, "key", "size", "row_no")).alias("best")).select("source", F.col("best.row_no").alias("last_row"))
    final = decided.alias("s").join(closest.alias("t"), same_source, "left").withColumn("extra", F.greatest("extra", F.coalesce(F.col("row_no") == F.col("last_row"), F.lit(False)).cast("int")))
    copies = F.col("epochs") + F.col("extra")
    return final.select("doc_id", "s.source", "size", "source_size", "target", "epochs", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row_no")
