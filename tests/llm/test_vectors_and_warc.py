"""Vector searches and WARC archives against brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pytest

from weftline.llm import ann, topk, warc
from weftline.llm.shared import stored

VECTORS = "vec_id long, embedding array<float>, v string, list long, label int"


def rows_of(array, start=0):
    return [(start + i, [float(x) for x in v], "clash", 1, 0) for i, v in enumerate(array)]


ODD = [(900, None, None, None, None), (901, [None, 1.0, 2.0, 3.0], None, None, None), (902, [float("nan"), 1.0, 2.0, 3.0], None, None, None), (903, [float("inf"), 1.0, 2.0, 3.0], None, None, None), (904, [1.0], None, None, None), (None, [1.0, 1.0, 1.0, 1.0], None, None, None), (905, [0.0, 0.0, 0.0, 0.0], None, None, None), (906, [], None, None, None)]


def nearest(ids, v, k):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        order = [j for j in np.lexsort((ids, d))[:k] if j != i]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def highest(ids, v, k):
    z, out = np.floor(1024 * v).astype(object), {}
    for i in np.flatnonzero(ids % 100 == 0):
        s = [(int(ids[j]), int(sum(a * b for a, b in zip(z[i], z[j], strict=True)))) for j in range(len(ids)) if j != i]
        out[int(ids[i])] = sorted(s, key=lambda x: (-x[1], x[0]))[:k]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


@pytest.fixture(scope="module")
def known(embeddings):
    rows = [r for r in embeddings.collect() if r["embedding"] is not None]
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(float)


IS_QUERY = "vec_id % 100 = 0"


def test_ann_whole_table(embeddings, known):
    want, got = nearest(*known, 10), by_query(ann.search(embeddings, IS_QUERY))
    assert set(got) == set(want)
    assert sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    place = {int(i): n for n, i in enumerate(known[0])}
    for q, found in got.items():
        for x, score in found:
            assert np.isclose(score, np.sqrt(((known[1][place[q]] - known[1][place[x]]) ** 2).sum()), rtol=1e-12)


def test_ann_recall_with_many_lists(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16))
    v = (centers[rng.integers(0, 40, 6000)] + rng.normal(scale=0.3, size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame(rows_of(v), VECTORS)
    settings = ann.Settings(list_size=30, lists=24, sample=2000)
    want, got = nearest(np.arange(6000), v.astype(float), 10), by_query(ann.search(df, IS_QUERY, settings))
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_ann_recall_without_structure(spark):
    v = np.random.default_rng(10).normal(size=(20_000, 32)).astype(np.float32)
    settings = ann.Settings(list_size=5)
    assert len(ann.balanced_centroids(v.astype(float), 4000)) > 4000  # far more lists than settings.lists
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    want, got = nearest(np.arange(20_000), v.astype(float), 10), by_query(ann.search(df, IS_QUERY, settings))
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    print(f"recall {hits / (10 * len(want))}")
    assert hits >= 0.9 * 10 * len(want)


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(7)
    graph = ann.centroid_graph(rng.normal(size=(4000, 8)), 512, 16)
    q = rng.normal(size=(200, 8)).astype(np.float32)
    number, distance = graph.search(q, 5, 32)
    exact = np.sqrt(((q[:, None] - graph.centroids[None]) ** 2).sum(2))
    assert (number[:, 0] == exact.argmin(1)).mean() > 0.95
    assert np.allclose(distance[:, 0], exact[np.arange(200), number[:, 0]], atol=1e-3)


def test_balanced_parts():
    rng = np.random.default_rng(8)
    assert len(ann.balanced_centroids(rng.normal(size=(1000, 4)), 64)) == 64
    assert len(ann.balanced_centroids(np.ones((50, 4)), 8)) == 1


def test_topk_whole_table(embeddings, known):
    assert by_query(topk.search(embeddings, IS_QUERY)) == highest(*known, 10)


@pytest.mark.parametrize("hot", [0, 400])
def test_topk_ties_and_hot_vectors(spark, hot):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(300, 6)).round(1), np.ones((hot, 6))]).astype(np.float32)
    df = spark.createDataFrame(rows_of(v), VECTORS)
    ids = np.arange(len(v))
    assert by_query(topk.search(df, IS_QUERY, k=7)) == highest(ids, v.astype(float), 7)
    assert by_query(ann.search(df, IS_QUERY, k=7)).keys() == nearest(ids, v.astype(float), 7).keys()


def test_topk_beyond_doubles(spark):
    v = np.array([[2.0**18, 3.0], [2.0**18, 1.5], [-(2.0**18), 1.0], [1.0, 1.0]], np.float32)
    df = spark.createDataFrame(rows_of(v), VECTORS)
    assert by_query(topk.search(df, IS_QUERY)) == highest(np.arange(4), v.astype(float), 10)


def test_searches_of_odd_rows(spark):
    good = [(0, [1.0, 2.0, 3.0, 4.0], "", 0, 0), (100, [1.0, 2.0, 3.0, 4.0], "", 0, 0), (7, [-1.0, 0.5, 0.25, 1.0], "", 0, 0), (7, [-1.0, 0.5, 0.25, 1.0], "", 0, 0)]
    df = spark.createDataFrame([*good, *ODD], VECTORS)
    near = by_query(ann.search(df, IS_QUERY))
    assert {q: [x for x, _ in found] for q, found in near.items()} == {0: [100, 7, 7], 100: [0, 7, 7]}
    best = by_query(topk.search(df, IS_QUERY))
    assert [x for x, _ in best[0]] == [100, 7, 7, 905]
    assert set(best) == {0, 100}  # 900 has no vector
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, IS_QUERY).count() == topk.search(none, IS_QUERY).count() == 0
    alone = spark.createDataFrame(good[:1], VECTORS)
    assert ann.search(alone, IS_QUERY).count() == topk.search(alone, IS_QUERY).count() == 0


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    """Twenty ids, two different vectors each: both rows of a query's id are queries, and each is a candidate for the other."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(40, 4)).round(2).astype(np.float32).astype(float)
    ids = np.repeat(np.arange(20) * 10, 2)
    df = spark.createDataFrame([(int(i), x.tolist(), "", 1, 0) for i, x in zip(ids, v, strict=True)], VECTORS)
    z = np.floor(1024 * v).astype(int)
    want_top, want_near = [], []
    for i in np.flatnonzero(ids % 100 == 0):
        others = [j for j in range(40) if j != i]
        top = sorted((-int(z[i] @ z[j]), int(ids[j])) for j in others)[:10]
        near = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), int(ids[j])) for j in others)[:10]
        want_top += [(int(ids[i]), n + 1, x, -s) for n, (s, x) in enumerate(top)]
        want_near += [(int(ids[i]), n + 1, x, s) for n, (s, x) in enumerate(near)]
    assert sorted(tuple(r) for r in topk.search(df, IS_QUERY).collect()) == sorted(want_top)
    got = sorted(tuple(r) for r in ann.search(df, IS_QUERY).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want_near)]


def test_topk_of_huge_components(spark):
    """Products far beyond a long are ranked exactly; only the shown score ends there. Nothing finite is kept out."""
    most = (1 << 63) - 1
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [-(2.0**40), 0.0]), (4, [1.0, 1.0]), (5, [1e306, 0.0]), (6, [2.0**46, 0.0]), (7, [-1e308, 0.0]), (100, [1.7e308, -1.0]), (200, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: topk.whole_numbers(np.array(v)) for i, v in rows}
    got = by_query(topk.search(df, IS_QUERY))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)
        assert found == [(i, max(-most - 1, min(most, -s))) for s, i in want]


def test_topk_of_one_wide_vector(spark):
    df = spark.createDataFrame([(0, [2.0**46]), (1, [1 / 1024]), (2, [2 / 1024])], "vec_id long, embedding array<double>")
    assert by_query(topk.search(df, IS_QUERY)) == {0: [(2, 2**57), (1, 2**56)]}
    assert by_query(topk.search(df, "vec_id = 1")) == {1: [(0, 2**56), (2, 2)]}


def test_keys_are_in_the_order_of_numbers():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**600, -(2**600), 10**40, -(10**40), 65535, 65536])
    assert sorted(numbers, key=topk.sort_key) == numbers


def test_ann_searches_everything_where_lists_hold_too_few(spark):
    """Lists of one vector, of which a query reads one."""
    v = np.random.default_rng(12).normal(size=(300, 3)).astype(np.float32)
    df = spark.createDataFrame(rows_of(v), VECTORS)
    settings = ann.Settings(list_size=1, lists=1, replicas=1, recall=0.0)
    want, got = nearest(np.arange(300), v.astype(float), 10), by_query(ann.search(df, IS_QUERY, settings))
    assert {q: [x for x, _ in found] for q, found in got.items()} == {q: [x for x, _ in found] for q, found in want.items()}


PAGES = "page_id long, url string, html string, payload binary, row_no string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    got = {r["record_id"]: r for r in warc.archive_and_read(pages).collect()}
    assert got.keys() == html.keys()
    for i, text in html.items():
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(text.encode()), sha(text), "response", None)


def test_warc_odd_rows_and_files(spark, tmp_path):
    long = "é" * 700_000
    rows = [(1, "http://a/\n x", "same", b"", "x"), (2, None, "same", None, None), (3, "http://c", None, None, None), (4, "http://d", "", None, None), (5, "http://e", long, None, None), (5, "http://e", long, None, None), (None, "http://f", "other", None, None)]
    path = f"file://{tmp_path}/w"
    got = warc.archive_and_read(stored(spark.createDataFrame(rows, PAGES).repartition(3)), path=path).collect()
    assert len(got) == len(rows)
    want = {(1, 4, sha("same"), "revisit", 2), (2, 4, sha("same"), "response", None), (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", None), (5, 1_400_000, sha(long), "response", None), (5, 1_400_000, sha(long), "revisit", 5), (None, 5, sha("other"), "response", None)}
    assert {tuple(r[c] for c in ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got} == want
    chunks = warc.read_warc(spark, path).where("record_id = 5 and record_type = 'response'").orderBy("chunk").collect()
    assert len(chunks) == -(-1_400_000 // warc.CHUNK)
    assert b"".join(bytes(c["data"]) for c in chunks).decode() == long
    assert [c["so_far"] for c in chunks][-1] == 1_400_000
    assert chunks[0]["digest"] == base64.b32encode(hashlib.sha1(bytes(chunks[0]["data"])).digest()).decode()
    text = b"".join(gzip.decompress((tmp_path / "w" / f[0]).read_bytes()) for f in spark.read.parquet(f"{path}/manifest").select("file").collect())
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    assert b"WARC-Type: revisit" in text
    assert b"WARC-Target-URI: http://a/x\r\n" in text


def test_warc_smallest_size_that_is_deduplicated(spark):
    pages = spark.createDataFrame([(1, None, "ab", None, None), (2, None, "ab", None, None), (3, None, "abcd", None, None), (4, None, "abcd", None, None)], PAGES)
    got = {r["record_id"]: r["record_type"] for r in warc.archive_and_read(pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_rows_are_numbered_once(spark, tmp_path, monkeypatch):
    plans, write = [], warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda rows, path: plans.append(rows._jdf.queryExecution().analyzed().toString()) or write(rows, path))
    warc.archive(spark.createDataFrame([(1, None, "x", None, None)], PAGES), f"file://{tmp_path}/w")
    assert "monotonically_increasing_id" not in plans[0]


def test_files_no_manifest_names_are_ignored(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(spark.createDataFrame([(1, None, "x", None, None)], PAGES), path)
    (tmp_path / "w" / "part-00009-lost.warc.gz").write_bytes(b"half a file")
    assert warc.read_back(spark, path).count() == 1
