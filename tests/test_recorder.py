"""Logs that grow, read by a stream that is stopped and goes on, so much at a time; and ids in the order of a language."""

from __future__ import annotations

import json

from weftline.operators import graph
from weftline.streaming import assembly
from weftline.streaming.recorder import _Log, recorder_log


def line(session, i, **more):
    return json.dumps({"session": session, "request_id": f"r{i}", "ts": f"2024-01-01T00:00:{i % 60:02d}+00:00", "event": "dataReceived", "size": i, **more}) + "\n"


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(text)


def test_stopped_and_resumed(spark, tmp_path):
    """Files grow between runs, in the middle of a line too; every whole line comes once."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    progress, checkpoint = f"file://{tmp_path}/progress", str(tmp_path / "checkpoint")
    want = []

    def run():
        events = recorder_log(spark, f"file://{logs}", progress, batch_bytes=1500, split=400).select("session", "request_id", "size")
        running = assembly.snapshots(events, str(out), checkpoint)
        running.processAllAvailable()
        running.stop()
        return sorted((r["session"], r["request_id"], r["size"]) for r in spark.read.parquet(str(out)).collect())

    for turn in range(3):
        for session in ("a", "b"):
            rows = range(20 * turn, 20 * turn + 20)
            append(logs / session / "log.jsonl", "".join(line(session, i, url="é" * (i % 7)) for i in rows))
            want += [(session, f"r{i}", i) for i in rows]
        if turn == 1:
            append(logs / "a" / "log.jsonl", "no json\n[]\n{}\n" + line("", 1))
            half = line("b", 99)
            append(logs / "b" / "log.jsonl", half[:30])
        if turn == 2:
            (logs / "new.jsonl").write_text(line("c", 1) * 3)
            want += [("c", "r1", 1)] * 3
        if turn == 1:
            assert run() == sorted(want)
            append(logs / "b" / "log.jsonl", half[30:])
            want.append(("b", "r99", 99))
    assert run() == sorted(want)
    assert run() == sorted(want)
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) > 4  # the limit made several batches


def test_batches_are_limited(tmp_path):
    append(tmp_path / "x.jsonl", line("a", 1) * 50)
    one = len(line("a", 1))
    log = _Log(f"file://{tmp_path}", f"file://{tmp_path}/progress", 3 * one + 5, one * 2)
    first, second = log.latestOffset(), log.latestOffset()
    assert (first, second) == ({"x.jsonl": 3 * one}, {"x.jsonl": 6 * one})
    assert [(p.low, p.high) for p in log.partitions(first, second)] == [(3 * one, 5 * one), (5 * one, 6 * one)]
    assert sum(len(list(log.read(p))) for p in log.partitions({}, second)) == 6
    append(tmp_path / "y.jsonl", line("b", 1, url="u" * 100_000))  # longer than the limit: still one line
    log = _Log(f"file://{tmp_path}", f"file://{tmp_path}/other", 10, 7)
    assert log.latestOffset() == {"x.jsonl": one}
    wide = _Log(f"file://{tmp_path}", f"file://{tmp_path}/third", 51 * one, 1000)
    end = wide.latestOffset()
    assert end["y.jsonl"] == len(line("b", 1, url="u" * 100_000))
    assert sum(len(list(wide.read(p))) for p in wide.partitions({}, end)) == 51


def test_ids_in_the_order_of_a_language(spark):
    ids = ["b", "B", "a", "Á", "á", "A", "ab", "z", "é", "f", "E"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(graph.by_language("id"), "id").collect()
    assert [r["id"] for r in rows] == ["a", "A", "á", "Á", "ab", "b", "B", "E", "é", "f", "z"]
