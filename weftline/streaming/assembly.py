"""Requests and responses put together from a stream of network events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Network events: requestWillBeSent, responseReceived, dataReceived, loadingFinished, loadingFailed.
EVENTS = T.StructType(
    [T.StructField(n, k) for n, k in (("session", T.StringType()), ("request_id", T.StringType()), ("ts", T.TimestampType()), ("event", T.StringType()), ("url", T.StringType()), ("method", T.StringType()), ("status", T.IntegerType()), ("size", T.LongType()), ("redirect", T.BooleanType()))]
)

EXCHANGES = "session string, request_id string, hop int, predecessor string, url string, method string, status int, size long, started timestamp, ended timestamp, body_state string"
_MADE = EXCHANGES.replace("timestamp", "long")
_COLUMNS = [c.split()[0] for c in EXCHANGES.split(", ")]
_STATE = "requests string"


class _Assembly(StatefulProcessor):
    """The requests of a bucket, each with its events in order; a redirect ends a hop and begins the next under the same id, a timer ends what never finished.

    Times are microseconds. A bucket is one call and one value in the store for a batch, however many requests it has: those that are open, as JSON.
    """

    def __init__(self, grace_ms: int):
        self.grace = grace_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        held, out = self._held(), []
        waiting = bool(held)
        events = pd.concat(list(rows)).sort_values("us", kind="stable")
        for session, request_id, us, event, url, method, status, size, redirect in zip(*(events[c].array for c in _TAKEN), strict=True):
            request = session, request_id
            own = held.get(request)
            if own is not None:
                own[-1] = us
            if event == "requestWillBeSent":
                hop = 0
                if own and redirect is not None and redirect:
                    out.append(_exchange(request, own, us, "not-applicable"))
                    hop = own[0] + 1
                held[request] = [hop, url, method, None, 0, us, us]
            elif own is None:
                continue  # its beginning was late or never seen
            elif event == "responseReceived":
                own[3] = None if pd.isna(status) else int(status)
            elif event == "dataReceived":
                own[4] += 0 if pd.isna(size) else int(size)
            elif event in ("loadingFinished", "loadingFailed"):
                out.append(_exchange(request, own, us, "stored" if event == "loadingFinished" else "unavailable"))
                del held[request]
        self._keep(held, waiting)
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        gone = {request for request, own in held.items() if self._ends(own) <= now}
        out = [_exchange(request, held.pop(request), None, "unavailable") for request in gone]
        self._keep(held, True)
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def _held(self) -> dict[tuple, list]:
        stored = self.held.get()
        return {(r[0], r[1]): r[2:] for r in json.loads(stored[0])} if stored else {}

    def _ends(self, own: list) -> int:
        return (own[-1] + self.grace) // 1000

    def _keep(self, held: dict[tuple, list], waiting: bool) -> None:
        """Stores what is open, with one timer for the first of it to end; a timer goes off once the watermark has passed it, so it stands a millisecond before."""
        for timer in list(self.handle.listTimers()) if waiting else ():
            self.handle.deleteTimer(timer)
        if held:
            self.held.update((json.dumps([[*request, *map(_plain, own)] for request, own in held.items()]),))
            self.handle.registerTimer(min(map(self._ends, held.values())) - 1)
        elif waiting:
            self.held.clear()

    def close(self) -> None:
        pass


_TAKEN = ["session", "request_id", "us", "event", "url", "method", "status", "size", "redirect"]


def _plain(x: object) -> object:
    return x.item() if hasattr(x, "item") else x


def _exchange(request: tuple, own: list, ended: int | None, body_state: str) -> tuple:
    session, request_id = request
    hop, url, method, status, size, started, _ = own
    return session, request_id, hop, f"{request_id}#{hop - 1}" if hop else None, url, method, status, size, started, ended, body_state


#: The state store that keeps timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def network_events(spark: SparkSession, path: str, *, files_at_once: int = 100) -> DataFrame:
    """A stream of EVENTS from JSON lines in files below path, as a recorder drops them there; lines that aren't events are left out."""
    lines = spark.readStream.schema(EVENTS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").json(path)
    return lines.where("session is not null and request_id is not null and ts is not null")


def exchanges(events: DataFrame, *, late: str = "10 seconds", grace_ms: int = 10_000, buckets: int = 1024) -> DataFrame:
    """Finished exchanges of a stream of EVENTS, each request known by (session, request_id); events later than ``late`` are dropped by the watermark.

    grace_ms: how long a body may take after the last event of its request before it counts as unavailable, by event time. Requests share state by buckets of
    their hash, as each key costs calls to the store in every batch; a task holds one bucket's rows of a batch. Needs a state store that keeps timers, which is set.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    bucket = F.pmod(F.xxhash64("session", "request_id"), F.lit(buckets)).cast("int")
    keyed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).withColumn("bucket", bucket).groupBy("bucket")
    made = keyed.transformWithStateInPandas(_Assembly(grace_ms), _MADE, "Append", "EventTime")
    return made.withColumn("started", F.timestamp_micros("started")).withColumn("ended", F.timestamp_micros("ended"))


def idle_periods(events: DataFrame, *, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of a session's activity, each ended by a gap: (session, started, ended, events)."""
    bursts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "session").agg(F.count(F.lit(1)).alias("events"))
    return bursts.select("session", F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "events")


def before_closing(bodies: DataFrame, closings: DataFrame, *, late: str = "10 seconds", told: str = "closing") -> DataFrame:
    """Bodies (mission_id, ts, ...) of a stream that come before their mission's evidence was closed (mission_id, closed).

    What came later is counted in the stream's progress: observed metrics of the name told, taken and late.
    """
    joined = bodies.withWatermark("ts", late).join(closings, "mission_id")
    kept = F.col("ts") <= F.col("closed")
    return joined.observe(told, F.count_if(kept).alias("taken"), F.count_if(~kept).alias("late")).where(kept).drop("closed")


def snapshots(stream: DataFrame, path: str, checkpoint: str, *, every: str = "100 milliseconds"):  # noqa: ANN201
    """Writes a stream as Parquet, a batch at most so often; started again it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()


def drained(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Runs a stream over all that is there and ends; what it observed, summed over its batches."""
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    running.awaitTermination()
    sums: dict[str, int] = {}
    for batch in running.recentProgress:
        for metrics in batch.observedMetrics.values():
            for name, n in metrics.asDict().items():
                sums[name] = sums.get(name, 0) + n
    return sums
