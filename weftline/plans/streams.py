"""Streams that are drained: what a recorder would have sent for each event, in two parts of which the second comes after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import capture
from ..sources.tables import dealt, shared_folder
from ..streaming import assembly
from .views import RESPONSES, with_

#: Where the first part of a stream ends.
_RESTART = "2024-01-16 00:00:00"


def _network(spark: SparkSession, sf: str) -> DataFrame:
    """Network events of each event, at whole milliseconds (halves up) as a recorder tells them: its request, for some a redirect, response, data, and for most an end."""
    e, k = dealt(capture.table(spark, sf, "events")).withColumn("ts", F.timestamp_millis(F.expr("floor((unix_micros(cast(ts as timestamp)) + 500) / 1000)").cast("long"))), F.col("event_id")
    sent = lambda name, ms, holds, **more: F.when(holds, F.struct(F.lit(name).alias("event"), F.lit(ms).alias("ms"), *[more.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("url", "string"), ("method", "string"), ("status", "int"), ("size", "long"), ("redirect", "boolean"))]))
    url = F.concat(F.lit("https://n.test/"), "event_type", F.lit("?"), k)
    rows = F.array(
        sent("requestWillBeSent", 0, F.lit(True), url=url, method=F.lit("GET"), redirect=F.lit(False)), sent("requestWillBeSent", 200, k % 11 == 3, url=F.concat(url, F.lit("&moved")), method=F.lit("POST"), redirect=F.lit(True)),
        sent("responseReceived", 500, k % 3 > 0, status=F.when(F.col("event_type") == "error", 500).otherwise(200)), sent("dataReceived", 700, F.lit(True), size=F.length("props").cast("long")),
        sent("dataReceived", 800, k % 5 == 0, size=k), sent("loadingFinished", 1000, (k % 7 > 0) & (k % 13 != 5)), sent("loadingFailed", 1000, (k % 7 > 0) & (k % 13 == 5)),
    )
    every = e.select(F.concat(F.lit("s"), F.col("user_id") % 50).alias("session"), F.concat(F.lit("r"), k).alias("request_id"), "ts", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x"))
    return every.select("session", "request_id", (F.col("ts") + F.make_dt_interval(secs=F.col("x.ms") / 1000)).alias("ts"), "x.event", "x.url", "x.method", "x.status", "x.size", "x.redirect")


def _in_two_parts(spark: SparkSession, rows: DataFrame, stream, schema: object) -> tuple[DataFrame, dict[str, int]]:  # noqa: ANN001
    """What a stream made of rows up to _RESTART and, run anew on its checkpoint, of the others; and what it observed."""
    folder, observed = shared_folder(spark), {}
    for n, part in enumerate((F.col("ts") < F.lit(_RESTART).cast("timestamp"), F.col("ts") >= F.lit(_RESTART).cast("timestamp"))):
        rows.where(part).write.parquet(f"{folder}/in/{n}")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        for name, count in assembly.drained(stream(source), f"{folder}/out", f"{folder}/checkpoint").items():
            observed[name] = observed.get(name, 0) + count
    return spark.read.parquet(f"{folder}/out"), observed


def streamed_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Exchanges put together by a stream with state and timers."""
    rows = _network(spark, sf)
    made, _ = _in_two_parts(spark, rows, lambda source: assembly.exchanges(source, grace_ms=5000), rows.schema)
    ms = lambda c: F.unix_millis(c).alias(c)
    return made.select("session", "request_id", "hop", "predecessor", "url", "method", "status", "size", ms("started"), ms("ended"), "body_state")


def streamed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of each mission that came before it was closed, and how many of all came too late."""
    bodies = capture.responses(spark, sf).where("body_id is not null").select("mission_id", F.col("ts").cast("timestamp").alias("ts"), "id", "content_hash")
    missions = bodies.groupBy("mission_id").agg(F.timestamp_seconds(F.unix_seconds(F.min("ts")) + F.floor(F.expr("(unix_seconds(max(ts)) - unix_seconds(min(ts))) * 3 / 4"))).alias("closed"))
    folder = shared_folder(spark)
    missions.write.parquet(folder)
    closings = spark.read.schema(missions.schema).parquet(folder)
    kept, observed = _in_two_parts(spark, bodies, lambda source: assembly.before_closing(source, closings), bodies.schema)
    return kept.groupBy("mission_id").agg(F.count(F.lit(1)).alias("taken"), F.count_distinct("content_hash").alias("bodies")).withColumn("late_in_all", F.lit(observed.get("late", 0)).cast("long"))


QUERIES = {f.__name__: f for f in (streamed_exchanges, streamed_bodies)}

_GONE = "epoch_ms(ts) + CASE WHEN event_id % 5 = 0 THEN 800 ELSE 700 END + 5000 <= (SELECT max(epoch_ms(ts) + CASE WHEN event_id % 7 > 0 THEN 1000 WHEN event_id % 5 = 0 THEN 800 ELSE 700 END) FROM events) - 10000"

ORACLE_SQL = {
    "streamed_exchanges": f"""WITH e AS (SELECT *, 's' || (user_id % 50) AS session, 'r' || event_id AS request_id, 'https://n.test/' || event_type || '?' || event_id AS url, event_id % 11 = 3 AS moved FROM events)
SELECT session, request_id, 0 AS hop, NULL AS predecessor, url, 'GET' AS method, NULL AS status, 0 AS size, epoch_ms(ts) AS started, epoch_ms(ts) + 200 AS ended, 'not-applicable' AS body_state FROM e WHERE moved
UNION ALL SELECT session, request_id, CASE WHEN moved THEN 1 ELSE 0 END, CASE WHEN moved THEN request_id || '#0' END, CASE WHEN moved THEN url || '&moved' ELSE url END, CASE WHEN moved THEN 'POST' ELSE 'GET' END,
  CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END, length(props) + CASE WHEN event_id % 5 = 0 THEN event_id ELSE 0 END, epoch_ms(ts) + CASE WHEN moved THEN 200 ELSE 0 END,
  CASE WHEN event_id % 7 > 0 THEN epoch_ms(ts) + 1000 END, CASE WHEN event_id % 7 > 0 AND event_id % 13 <> 5 THEN 'stored' ELSE 'unavailable' END FROM e WHERE event_id % 7 > 0 OR {_GONE}""",
    "streamed_bodies": with_(RESPONSES, """, b AS (SELECT * FROM responses WHERE body_id IS NOT NULL), c AS (SELECT mission_id, floor(epoch(min(ts))) + floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) * 3 / 4) AS closed FROM b GROUP BY 1),
k AS (SELECT b.*, epoch(b.ts) <= c.closed AS taken FROM b JOIN c ON c.mission_id = b.mission_id)
SELECT mission_id, count(*) FILTER (WHERE taken) AS taken, count(DISTINCT content_hash) FILTER (WHERE taken) AS bodies, (SELECT count(*) FROM k WHERE NOT taken) AS late_in_all FROM k GROUP BY mission_id HAVING count(*) FILTER (WHERE taken) > 0"""),
}
