"""Body storage: chunks, ownership, missions and quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media, paths

CHUNK_BYTES = 1 << 20
RESERVE_BYTES = CHECK_BYTES = 16 << 20
ACTIVE_STATES = ("starting", "capturing", "finalizing", "building")


def body_chunks(bodies: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(storage_key, index, bytes) of bodies (storage_key, body binary); an empty body has no chunk. Numbers are exploded first, so no row holds all chunks of a body."""
    n = F.ceil(F.octet_length("body") / chunk).cast("int")
    numbers = bodies.where(F.octet_length("body") > 0).select("storage_key", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    return numbers.select("storage_key", "index", F.substring(F.col("body"), F.col("index") * chunk + 1, F.lit(chunk)).alias("bytes"))


def committed(writes: DataFrame) -> DataFrame:
    """Bodies that count, of finished writes (write_id, position, expected_size, body): of equal bytes the first; a write of another size than
    expected is aborted."""
    sized = writes.where(F.octet_length("body") == F.coalesce("expected_size", F.octet_length("body"))).withColumn("content_hash", paths.content_hash(F.col("body")))
    return sized.withColumn("n", F.row_number().over(Window.partitionBy("content_hash").orderBy("position"))).select("write_id", "position", "content_hash", F.octet_length("body").cast("long").alias("size"), (F.col("n") > 1).alias("duplicate"))


def read_bodies(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(storage_key, body, complete) of bodies (storage_key, chunk_count) from their chunks in order; complete tells whether none is missing."""
    ordered = chunks.groupBy("storage_key").agg(F.array_sort(F.collect_list(F.struct("index", "bytes"))).alias("parts"))
    joined = bodies.join(ordered, "storage_key", "left").withColumn("parts", F.coalesce("parts", F.expr("cast(array() as array<struct<index: int, bytes: binary>>)")))
    whole = F.aggregate(F.col("parts.bytes"), F.lit(b""), lambda a, b: F.concat(a, b))
    return joined.select("storage_key", whole.alias("body"), (F.size("parts") == F.col("chunk_count")).alias("complete"))


def orphans(owners: DataFrame, mission: int) -> DataFrame:
    """Bodies that the mission owns and no other does: (content_hash); they go when it goes."""
    own = owners.where(F.col("mission_id") == mission).select("content_hash").distinct()
    others = owners.where(F.col("mission_id") != mission).select("content_hash").distinct()
    return own.join(others, "content_hash", "left_anti")


def latest_missions(states: DataFrame) -> DataFrame:
    """The last state of each mission, of rows (mission_id, ts, sequence, state)."""
    last = F.max_by(F.struct("state", "ts"), F.struct("ts", "sequence"))
    return states.groupBy("mission_id").agg(last.alias("last")).select("mission_id", "last.state", "last.ts")


def recovered(missions: DataFrame) -> DataFrame:
    """After a crash: missions that were active are interrupted and may be recovered."""
    active = F.col("state").isin(*ACTIVE_STATES)
    return missions.withColumn("recovery", F.when(active, "recoverable").otherwise("none")).withColumn("state", F.when(active, "interrupted").otherwise(F.col("state")))


def quota(quota_bytes: Column, usage: Column, needed: Column) -> Column:
    """available: what a quota leaves beside the reserve; checked: whether a write of so many bytes is checked; fits: whether it may go on."""
    available = F.greatest(F.lit(0), quota_bytes - usage - RESERVE_BYTES)
    checked = needed >= CHECK_BYTES
    return F.struct(available.alias("available"), checked.alias("checked"), (~checked | (needed <= available)).alias("fits"))


def hydrated(resources: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resources (storage_key, body binary, mime_type, url, ...) with bodies from storage (storage_key, body) where they hold none; text where the type is text."""
    held = bodies.groupBy("storage_key").agg(F.first("body").alias("stored_body"))
    joined = resources.join(held, "storage_key", "left").withColumn("body", F.coalesce("body", "stored_body")).drop("stored_body")
    return joined.withColumn("text", F.when(media.is_catalog_text(F.col("url"), F.col("mime_type")), F.decode("body", "utf-8")))


def without_inline_bodies(missions: DataFrame) -> DataFrame:
    """Mission records (..., bodies array of structs with a body) as they are persisted: no body stays inline."""
    kind = missions.schema["bodies"].dataType.elementType["body"].dataType
    return missions.withColumn("bodies", F.transform("bodies", lambda b: b.withField("body", F.lit(None).cast(kind))))


def within_budget(bodies: DataFrame, most: int) -> DataFrame:
    """Bodies (mission_id, sequence, size) with the bytes so far, and whether the mission still had room when each came."""
    before = Window.partitionBy("mission_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bodies.withColumn("so_far", F.sum("size").over(before)).withColumn("kept", F.col("so_far") - F.col("size") < most)
