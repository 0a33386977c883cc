"""Clustering and near-duplicates of embeddings against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from weftline.llm import clusters, lattice
from weftline.llm.shared import join_spread, stored

VECTORS = "vec_id long, embedding array<double>, v string, cluster int, row_no long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 7, 1, "x") for i, v in rows], VECTORS)


# clusters ---------------------------------------------------------------------------------------------------------


def clustered(rows, k, rounds, dims, scale):
    """The same by plain loops over whole numbers of any size."""
    kept = [(i, [scale * int(x) if abs(x) >= 2**60 else math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in drawn[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(centroids))]
        centroids = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def same_clusters(spark, rows, **how):
    found = clusters.cluster(frame(spark, rows), **how)
    want, centroids = clustered(rows, **how)
    assert found.centroids == centroids
    key = lambda r: (r[0] is None, r)
    most = (1 << 63) - 1
    assert sorted((tuple(r) for r in found.assigned.select("id", "cluster", "distance").collect()), key=key) == sorted(((i, c, min(d, most)) for i, c, d in want), key=key)
    told = clusters.with_inertia(found).collect()
    inertia = {j: min(most, sum(d for _, c, d in want if c == j)) for j in range(len(centroids))}
    assert all(r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == min(most, sum(d for *_, d in want)) for r in told)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in told)


@pytest.mark.parametrize("spread", [0.05, 1.0, 40.0])
def test_clusters_as_by_loops(spark, spread):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 5))[rng.integers(0, 12, 400)] * 3 + rng.normal(scale=spread, size=(400, 5))
    same_clusters(spark, list(enumerate(v.tolist())), k=16, rounds=3, dims=5, scale=64)


def test_clusters_of_ties_and_repeats(spark):
    """Vectors half way between centroids, centroids that are equal, clusters that become empty."""
    rows = [(i, [(i * 7 % 5) - 2, (i % 3) - 1]) for i in range(90)] + [(5, [0, 0]), (5, [0, 0]), (None, [1, 1]), (None, [1, 1])]
    same_clusters(spark, rows, k=8, rounds=3, dims=2, scale=1)
    same_clusters(spark, [(i, [1, 1]) for i in range(40)], k=16, rounds=2, dims=2, scale=64)


def test_clusters_of_odd_rows(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, -0.5]), (8, [0.0, 0.0])]
    same_clusters(spark, odd, k=16, rounds=3, dims=2, scale=64)
    same_clusters(spark, [(None, [1.0, 2.0])], k=16, rounds=3, dims=2, scale=64)
    assert clusters.with_inertia(clusters.cluster(frame(spark, odd[:6]), dims=2)).count() == 0


def test_clusters_of_huge_numbers(spark):
    """Components whose squares no long holds are compared exactly, beside small ones."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))] + [(100 + i, [x * 10.0**p, 1.0, -(2.0**p)]) for i, (x, p) in enumerate(zip(rng.normal(size=40), [8, 20, 37, 300] * 10, strict=True))]
    same_clusters(spark, rows, k=16, rounds=3, dims=3, scale=64)


def test_annulus_holds_the_nearest():
    rng = np.random.default_rng(3)
    for low, high in ((-3, 4), (-1000, 1000), (-clusters.NARROW, clusters.NARROW)):
        c, v = rng.integers(low, high, (9, 4)), rng.integers(low, high, (300, 4))
        rings = clusters.Rings.of(c.tolist())
        want = [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c.tolist())) for x in v.tolist()]
        number, square = rings.nearest_of_all(v)
        assert [(int(s), int(n)) for s, n in zip(square, number, strict=True)] == want
        assert [rings.nearest(x)[::-1] for x in v.tolist()] == want


# lattice ----------------------------------------------------------------------------------------------------------


def linked(rows, cosine):
    """(id, n_links, component_id) of rows (id, vector) by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for length in {len(v) for (_, v), ok in zip(rows, good, strict=True) if ok}:
        at = [n for n, (_, v) in enumerate(rows) if good[n] and len(v) == length]
        x = np.array([rows[n][1] for n in at], float)
        x = x / np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                links[at[a]].append(at[b])
    out, seen = [None] * len(rows), set()
    for n in range(len(rows)):
        if n not in seen:
            group, todo = {n}, [n]
            while todo:
                more = set(links[todo.pop()]) - group
                group |= more
                todo += more
            seen |= group
            least = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
            for m in group:
                out[m] = (rows[m][0], len(links[m]), least)
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found_links(spark, rows, settings=lattice.Settings()):  # noqa: B008
    got = lattice.near_duplicates(frame(spark, rows), settings).collect()
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    return sorted(((r["id"], r["n_links"], r["component_id"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def near(rng, v, cosine):
    """A vector of just this cosine to v."""
    other = rng.normal(size=v.shape)
    other -= (other @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_e8_points_are_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice.decode(x)
    assert ((p * 2 % 2 == 0).all(1) | (p * 2 % 2 == 1).all(1)).all()
    assert (p.sum(1) % 2 == 0).all()
    away = ((x - p) ** 2).sum(1)
    for m in lattice._moves():
        assert (away <= ((x - p - m) ** 2).sum(1) + 1e-12).all()
    assert len(lattice._moves()) == len({tuple(m) for m in lattice._moves()}) == 240
    assert np.allclose((lattice._moves() ** 2).sum(1), 2)


def test_cells_don_t_depend_on_the_batch():
    rng = np.random.default_rng(5)
    plan = lattice.Plan.of(1_000_000, lattice.Settings())
    assert plan.blocks == 2
    unit = lattice.units(rng.normal(size=(300, 48)))
    whole = plan.looks(unit)
    assert all((plan.looks(unit[a : a + n])[0] == whole[a]).all() for a, n in ((0, 1), (17, 2), (100, 63)))
    assert len(np.unique(whole[0].reshape(-1))) == whole[0].size  # a vector looks into different cells


@pytest.mark.parametrize("n", [1000, 1_000_000])
def test_pairs_at_the_threshold_meet(n):
    """As many pairs at the threshold as to find a chance of one in a thousand, also with cells of two blocks."""
    rng = np.random.default_rng(6)
    plan = lattice.Plan.of(n, lattice.Settings())
    x = rng.normal(size=(3000, 64))
    a, b = plan.looks(lattice.units(x)), plan.looks(lattice.units(np.array([near(rng, v, 0.95) for v in x])))
    assert ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1).all()


@pytest.mark.parametrize("block", [512, 20])
def test_links_as_by_all_pairs(spark, block):
    """Groups of near vectors around some centres, copies, chains and pairs close to the threshold; cells cut into many blocks."""
    rng = np.random.default_rng(7)
    v = list(rng.normal(size=(250, 24)))
    v += [near(rng, v[0], c) for c in rng.uniform(0.96, 0.999, 150)]
    v += [near(rng, v[1], c) for c in rng.uniform(0.9, 0.99, 100)]
    v += [near(rng, v[i], c) for i in range(50, 90) for c in (0.9499999, 0.9500001)]
    v += [v[3]] * 40 + [v[4] * 2, v[4] * 3, v[5] * 1e-200, v[6] * 1e200]
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    assert found_links(spark, rows, lattice.Settings(block=block)) == linked(rows, 0.95)


def test_links_with_cells_of_two_blocks(spark):
    rng = np.random.default_rng(8)
    v = list(rng.normal(size=(150, 64)))
    v += [near(rng, v[i % 30], c) for i, c in enumerate(rng.uniform(0.94, 0.99, 200))]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    settings = lattice.Settings(crowd=1)
    assert lattice.Plan.of(len(rows), settings).blocks == 2
    assert found_links(spark, rows, settings) == linked(rows, 0.95)


def test_links_of_odd_rows(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0]), (10, [-1.0]), (11, [3.0]), (None, [0.0, -1.0]), (None, [-0.0, -1.0]), (12, [0.0, -1.0]), (None, None), (13, [1e308, 1e308]), (14, [1e-320, 0.0])]
    assert found_links(spark, odd) == linked(odd, 0.95)
    assert found_links(spark, []) == []
    assert found_links(spark, odd[:3]) == linked(odd[:3], 0.95)


def test_join_of_heavy_keys(spark):
    left = stored(spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, n long"))
    right = stored(spark.createDataFrame([(i, str(i)) for i in range(3000)], "k long, told string"))
    got = join_spread(left, right, ["k"])
    assert sorted((r["n"], r["told"]) for r in got.collect()) == sorted((i, str(0 if i % 3 else i)) for i in range(3000))
