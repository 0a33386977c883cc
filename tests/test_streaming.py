"""Streams over files, drained, against what batches give."""

from __future__ import annotations

from datetime import datetime, timedelta

from weftline.streaming import assembly

T0 = datetime(2024, 1, 1)


def event(seconds, request, kind, **more):
    return ("s", request, T0 + timedelta(seconds=seconds), kind, more.get("url"), more.get("method"), more.get("status"), more.get("size"), more.get("redirect"))


def stream_of(spark, path, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, assembly.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    return spark.readStream.schema(assembly.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_exchanges(spark, tmp_path):
    first = [event(0, "r1", "requestWillBeSent", url="https://h/a", method="GET"), event(1, "r1", "requestWillBeSent", url="https://h/b", method="GET", redirect=True), event(2, "r1", "responseReceived", status=200), event(3, "r1", "dataReceived", size=7), event(3, "r2", "requestWillBeSent", url="https://h/c", method="GET")]
    second = [event(4, "r1", "dataReceived", size=3), event(5, "r1", "loadingFinished"), event(6, "r3", "loadingFinished")]
    stream = stream_of(spark, str(tmp_path / "in"), first, second)
    assembly.drained(assembly.exchanges(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["request_id"], r["hop"], r["predecessor"], r["url"], r["size"], r["body_state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("r1", 0, None, "https://h/a", 0, "not-applicable"), ("r1", 1, "r1#0", "https://h/b", 10, "stored")]


def test_timeout_marks_unavailable(spark, tmp_path):
    early = [event(0, "r1", "requestWillBeSent", url="https://h/a", method="GET")]
    later = [event(100, "r2", "requestWillBeSent", url="https://h/b", method="GET"), event(101, "r2", "loadingFinished")]
    stream = stream_of(spark, str(tmp_path / "in"), early, later, [event(200, "r3", "requestWillBeSent", url="https://h/c", method="GET")])
    assembly.drained(assembly.exchanges(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["request_id"], r["body_state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("r1", "unavailable"), ("r2", "stored")} <= got


def test_idle_periods(spark, tmp_path):
    rows = [event(s, "r", "dataReceived") for s in (0, 0.3, 0.6, 2, 2.1, 60)]
    assembly.drained(assembly.idle_periods(stream_of(spark, str(tmp_path / "in"), rows, [event(120, "r", "dataReceived")])), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect())[-2:] == [2, 3]


def test_events_from_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"session":"s","request_id":"r1","ts":"2024-01-01T00:00:00Z","event":"requestWillBeSent","url":"https://h/a","method":"GET"}', "no json", '{"event":"dataReceived"}', '{"session":"s","request_id":"r1","ts":"2024-01-01T00:00:01Z","event":"loadingFinished"}']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    assembly.drained(assembly.exchanges(assembly.network_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r["request_id"], r["url"], r["body_state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("r1", "https://h/a", "stored")]


def test_bodies_before_closing(spark, tmp_path):
    """Bodies of closed missions count for nothing."""
    rows = [event(s, f"r{s}", "loadingFinished") for s in (1, 5, 9)]
    closings = spark.createDataFrame([("s", T0 + timedelta(seconds=5))], "mission_id string, closed timestamp")
    bodies = stream_of(spark, str(tmp_path / "in"), rows).withColumnRenamed("session", "mission_id")
    assembly.drained(assembly.before_closing(bodies, closings).select("request_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r1", "r5"]


def test_snapshots_go_on_where_they_ended(spark, tmp_path):
    folders = [str(tmp_path / x) for x in ("in", "out", "ck")]
    for n in range(2):
        stream = stream_of(spark, folders[0], [event(n, f"r{n}", "loadingFinished")])
        running = assembly.snapshots(stream.select("request_id"), folders[1], folders[2])
        running.processAllAvailable()
        running.stop()
    assert sorted(r[0] for r in spark.read.parquet(folders[1]).collect()) == ["r0", "r1"]


def test_requests_of_one_bucket(spark, tmp_path):
    """Requests that share state stay apart; one ends when the watermark reaches its last event and the grace, another a millisecond later doesn't."""
    first = [event(s, r, "requestWillBeSent", url=f"https://h/{r}", method="GET") for s, r in ((0, "r1"), (0.001, "r2"), (5, "r3"))]
    second = [event(6, "r3", "dataReceived", size=2), event(7, "r3", "loadingFinished"), event(20, "r4", "requestWillBeSent", url="https://h/r4", method="GET")]
    stream = stream_of(spark, str(tmp_path / "in"), first, second)
    assembly.drained(assembly.exchanges(stream, buckets=1), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["request_id"], r["size"], r["started"], r["body_state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("r1", 0, T0, "unavailable"), ("r3", 2, T0 + timedelta(seconds=5), "stored")]


def test_exchanges_to_the_millisecond(spark, sf):
    """Times as the SQL rounds them, compared whole."""
    from weftline import plans

    from .oracle import database

    want = database(sf).execute(f"SELECT request_id, hop, started, ended FROM ({plans.oracle_sql()['streamed_exchanges']})").fetchall()
    got = [tuple(r) for r in plans.queries()["streamed_exchanges"](spark, sf).select("request_id", "hop", "started", "ended").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
