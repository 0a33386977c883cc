"""A store that grows by batches: what is known isn't written again, nothing counts before it is published, and missions go with what only they own."""

from __future__ import annotations

import pytest

from weftline.operators import storage
from weftline.operators.body_store import BodyStore

WRITES = "write_id string, mission_id long, position long, expected_size long, mime_type string, body binary"


def writes(spark, *rows):
    return spark.createDataFrame([(w, m, p, e, "text/plain", None if b is None else b.encode()) for w, m, p, e, b in rows], WRITES)


@pytest.fixture
def store(spark, tmp_path):
    return BodyStore(spark, f"file://{tmp_path}/store", chunk=4)


def held(store):
    bodies = store.table("bodies").select("storage_key", "content_hash", "chunk_count")
    read = {r["storage_key"]: (bytes(r["body"]).decode(), r["complete"]) for r in storage.read_bodies(store.table("chunks"), bodies.where("chunk_count > 0")).collect()}
    assert all(complete for _, complete in read.values())
    owned = store.table("owners").join(store.table("bodies"), "content_hash").select("mission_id", "storage_key").collect()
    return {(r["mission_id"], read.get(r["storage_key"], ("",))[0]) for r in owned}, len({r["storage_key"] for r in bodies.collect()})


def test_batches(spark, store):
    first = store.commit(0, writes(spark, ("a", 1, 0, None, "hello world"), ("b", 1, 1, 11, "hello world"), ("c", 2, 2, 3, "four"), ("d", 2, 3, 0, ""), ("e", 2, 4, None, "other")))
    assert sorted((r["write_id"], r["state"], r["duplicate"]) for r in first.collect()) == [("a", "committed", False), ("b", "committed", True), ("c", "aborted", False), ("d", "committed", False), ("e", "committed", False)]
    assert held(store) == ({(1, "hello world"), (2, ""), (2, "other")}, 3)
    second = store.commit(1, writes(spark, ("f", 2, 0, None, "hello world"), ("g", 3, 1, None, "new"), ("h", 2, 2, None, "other"), ("n", 3, 3, None, None)))
    assert sorted((r["write_id"], r["state"], r["duplicate"]) for r in second.collect() if r["write_id"] != "n") == [("f", "committed", True), ("g", "committed", False), ("h", "committed", True)]
    assert held(store) == ({(1, "hello world"), (2, ""), (2, "other"), (2, "hello world"), (3, "new")}, 4)
    assert store.commit(1, writes(spark, ("x", 9, 0, None, "again"))) is None  # a batch that comes again
    assert held(store)[1] == 4
    asked = store.table("bodies").select("content_hash").limit(1).union(spark.createDataFrame([("sha256:none",)], "content_hash string"))
    assert sorted(r["held"] for r in store.has(asked).collect()) == [False, True]


def test_what_was_broken_off_leaves_nothing(spark, store):
    store.commit(0, writes(spark, ("a", 1, 0, None, "kept")))
    store.stage(1, writes(spark, ("b", 1, 0, None, "lost")))  # and then the driver is gone
    assert held(store) == ({(1, "kept")}, 1)
    assert store.vacuum() > 0
    store.commit(1, writes(spark, ("b", 1, 0, None, "lost")))
    assert held(store) == ({(1, "kept"), (1, "lost")}, 2)


def test_missions_go_with_what_only_they_own(spark, store):
    store.commit(0, writes(spark, ("a", 1, 0, None, "shared"), ("b", 2, 1, None, "shared"), ("c", 1, 2, None, "only one")))
    store.commit(1, writes(spark, ("d", 2, 0, None, "only two")))
    second = [f for k, f in store.version().folders if k == "chunks"]
    assert store.remove_mission(1) == 1
    assert held(store) == ({(2, "shared"), (2, "only two")}, 2)
    assert len(set(second) & {f for _, f in store.version().folders}) == 1  # the folder that held none of them stays
    assert store.table("chunks").join(store.table("bodies"), "storage_key", "left_anti").count() == 0
    assert store.remove_mission(7) == 0
    assert store.remove_mission(2) == 2
    assert held(store) == (set(), 0)
    store.vacuum()
    assert held(store) == (set(), 0)
    store.commit(2, writes(spark, ("e", 3, 0, None, "shared")))
    assert held(store) == ({(3, "shared")}, 1)


def test_a_stream_of_batches(spark, store, tmp_path):
    """Each file is a batch; the stream is stopped, restarted and its last batch sent once more."""
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, 0, None, "t", b"x"), ("b", 1, 1, None, "t", b"y")], WRITES).coalesce(1).write.parquet(str(source / "one"))
    stream = lambda: spark.readStream.schema(WRITES).parquet(f"{source}/*").writeStream.foreachBatch(lambda df, n: store.commit(n, df)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    stream()
    spark.createDataFrame([("c", 2, 0, None, "t", b"x"), ("d", 2, 1, None, "t", b"z")], WRITES).coalesce(1).write.parquet(str(source / "two"))
    stream()
    assert held(store) == ({(1, "x"), (1, "y"), (2, "x"), (2, "z")}, 3)
    assert store.version().batches == {0, 1}


def test_one_writer_at_a_time(spark, store):
    before = store.version()
    store._publish(before, [], frozenset())
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store._publish(before, [], frozenset())
