"""Near-duplicates of embeddings by lattice hashing.

In each of several tables a unit vector is projected to a few blocks of eight numbers, and each block is decoded to its nearest point of the E8 lattice; the points
together are the vector's cell. A vector also looks into the neighbouring cells that its projections are nearest to. Two vectors meet where one looks into the
other's cell. How many tables there are follows from a simulation of pairs that are just similar enough, so that one is missed with a known small chance; how many blocks a
cell has follows from the number of vectors, so that cells stay small.

What meets is told apart in two steps. First each vector carries only 128 signs of random projections, and stays in a cell only if another vector there has few
enough different signs. What stays carries its components and is held against the others of its cell by the exact cosine. Cells of many vectors are dealt out
as pairs of blocks. A pair counts in the first table in which it meets, so links are counted, not listed: every block gives one row for each vector.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import components
from .shared import document_columns, join_spread, mixed, numbered, shared_dir, stored
from .vectors import as_bytes, finite


@dataclass(frozen=True)
class Settings:
    """cosine: links from here on; scale: of the projections against the lattice, whose points are about 1.4 apart; looks: cells a vector looks into, its own
    among them; missed: the chance of missing a pair just similar enough; crowd: vectors that a cell may hold, were they spread like random ones; chance: that of two random
    vectors to share a cell of one block; block: vectors that are held against each other at once."""

    cosine: float = 0.95
    scale: float = 0.5
    looks: int = 4
    missed: float = 1e-6
    crowd: int = 64
    chance: float = 4.4e-3
    signs: int = 128
    block: int = 512
    seed: int = 12


@functools.cache
def _moves() -> np.ndarray:
    """The 240 shortest vectors of E8: its steps to neighbouring points."""
    whole = [[a * (k == i) + b * (k == j) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if s.count(-0.5) % 2 == 0]
    return np.array([*whole, *halves], np.float64)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates and an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(-1) % 2)
    off = (x - near)[odd]
    worst = np.abs(off).argmax(-1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points to lines of eight numbers: whole coordinates or all halves, in either case of an even sum."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[:, None], whole, half)


@functools.lru_cache(maxsize=16)
def _choices(blocks: int, single: int, double: int) -> tuple:
    """Steps to try: none, one of the best of a block, or two of different blocks, as tuples of (block, place among its best)."""
    ones = [((b, i),) for b in range(blocks) for i in range(single)]
    twos = [((b, i), (c, j)) for b, c in itertools.combinations(range(blocks), 2) for i in range(double) for j in range(double)]
    return ((), *ones, *twos)


def cells(projected: np.ndarray, looks: int) -> np.ndarray:
    """(rows x looks) 64-bit names of the cells that lines of 8 b numbers look into, their own first, then the nearest others."""
    n, blocks = len(projected), projected.shape[1] // 8
    single = max(8, -(-looks // blocks))
    own, best, cost = [], [], []
    for b in range(blocks):
        x = projected[:, 8 * b : 8 * b + 8]
        own.append(decode(x))
        further = 2 - 2 * (x - own[b]) @ _moves().T  # what a step adds to the squared distance
        few = np.argsort(further, axis=1, kind="stable")[:, :single]
        best.append(few)
        cost.append(np.take_along_axis(further, few, 1))
    choices = _choices(blocks, single, 3)
    costs = np.stack([sum((cost[b][:, i] for b, i in steps), np.zeros(n)) for steps in choices], 1)
    costs[:, 0] = -np.inf
    order = np.argsort(costs, axis=1, kind="stable")[:, :looks]
    names = np.zeros((n, looks), np.uint64)
    home = np.concatenate(own, 1)
    for look in range(looks):
        point = home.copy()
        for k in np.unique(order[:, look]):
            rows = np.flatnonzero(order[:, look] == k)
            for b, i in choices[k]:
                point[rows, 8 * b : 8 * b + 8] += _moves()[best[b][rows, i]]
        name = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for column in (2 * point).astype(np.int64).astype(np.uint64).T:
            name = mixed(name * np.uint64(0xD1342543DE82EF95) + column)
        names[:, look] = name
    return names


def chance_to_meet(blocks: int, settings: Settings, pairs: int = 20_000) -> float:
    """How often two vectors of just the cosine meet in one table, by simulation; their projections are normal with that correlation."""
    random, c = np.random.default_rng(settings.seed), settings.cosine
    x, other = random.normal(size=(2, pairs, 8 * blocks)) * settings.scale
    a, b = cells(x, settings.looks), cells(c * x + math.sqrt(1 - c * c) * other, settings.looks)
    return float(((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean())


@dataclass(frozen=True)
class Plan:
    """How vectors of a table are hashed: tables of so many blocks, and the most signs in which similar vectors differ."""

    tables: int
    blocks: int
    apart: int
    settings: Settings

    @staticmethod
    def of(n: int, settings: Settings) -> Plan:
        blocks = 1
        while n * settings.chance**blocks > settings.crowd:
            blocks += 1
        chance = min(chance_to_meet(blocks, settings), 1 - 1e-9)
        p, tail, apart = math.acos(settings.cosine) / math.pi, 1.0, -1
        while tail > settings.missed:
            apart += 1
            tail -= math.comb(settings.signs, apart) * p**apart * (1 - p) ** (settings.signs - apart)
        return Plan(max(1, math.ceil(math.log(settings.missed) / math.log(1 - chance))), blocks, apart, settings)

    def looks(self, unit: np.ndarray) -> np.ndarray:
        """(rows x tables x looks) names of cells, of unit vectors of one length; names of tables and lengths differ."""
        dims, width = unit.shape[1], 8 * self.blocks
        projected = _rounded(unit, 20) @ _rounded(_projections(dims, self.tables * width, self.settings.seed) * self.settings.scale, 14) / (1 << 34)
        out = [cells(projected[:, t * width : (t + 1) * width], self.settings.looks) for t in range(self.tables)]
        salt = mixed(np.arange(self.tables, dtype=np.uint64) + np.uint64(dims << 20))
        return mixed(np.stack(out, 1) ^ salt[None, :, None]).view(np.int64)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ _projections(unit.shape[1], self.settings.signs, self.settings.seed + 1) > 0, axis=1)


def _rounded(x: np.ndarray, bits: int) -> np.ndarray:
    """Whole multiples of 2 ** -bits, in that unit: their products add up exactly in any order, so a vector has the same cells in whatever batch it comes."""
    return np.rint(np.ldexp(x, bits))


@functools.lru_cache(maxsize=4)
def _projections(dims: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims, width]).normal(size=(dims, width))


def units(v: np.ndarray) -> np.ndarray:
    """Unit vectors of finite lines that aren't zero; powers of two are taken out first, so that no square is too large or small."""
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    v = np.ldexp(v, -exponent[:, None])
    return v / np.sqrt((v * v).sum(1))[:, None]


def _by_length(vs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each length among vectors in bytes."""
    lengths = np.array([len(v) for v in vs])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer(b"".join([vs[i] for i in at]), "<f8").reshape(len(at), -1)


def _looked(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(cell, class, home, sketch): the cells that each class looks into."""
    each = plan.tables * plan.settings.looks
    home = np.zeros((plan.tables, plan.settings.looks), bool)
    home[:, 0] = True
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            for at, v in _by_length(part.column(1).to_pylist()):
                unit = units(v)
                sketch = [s.tobytes() for s in plan.sketches(unit)]
                row = np.repeat(np.arange(len(at)), each)
                yield pa.RecordBatch.from_arrays([pa.array(plan.looks(unit).reshape(-1)), part.column(0).take(pa.array(at[row])), pa.array(np.tile(home.reshape(-1), len(at))), pa.array(sketch, pa.binary()).take(pa.array(row))], names=["cell", "class", "home", "sketch"])


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Stored rows (cell, class, home, ...) of cells in which something meets, as groups (cell, i, j) of at most about 2 x block rows: a cell of more than block
    rows is cut into blocks, and each pair of them is a group; own tells the row's block."""
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    counted = join_spread(rows, stored(counts.select("cell", "n")), ["cell"])
    parts = F.ceil(F.col("n") / block).cast("int")
    blocked = counted.withColumn("own", F.pmod(F.xxhash64("class"), parts).cast("int")).withColumn("parts", parts)
    partner = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    large = blocked.where("parts > 1").withColumn("partner", partner).withColumn("i", F.least("own", "partner")).withColumn("j", F.greatest("own", "partner")).drop("partner")
    small = blocked.where("parts = 1").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    return small.unionByName(large).drop("n", "parts")


def _with_looks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(class, size, v, looks) of classes: the cells each looks into, in bytes."""
    for batch in batches:
        for at, v in _by_length(batch.column(2).to_pylist()):
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.tobytes() for x in plan.looks(units(v))], pa.binary())], names=["class", "size", "v", "looks"])


def _grouped(dealt: DataFrame, *carried: str) -> DataFrame:
    columns = ["class", "home", "own", *carried]
    packed = dealt.groupBy("cell", "i", "j").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return packed.select("cell", "i", "j", *[F.col(f"rows.{c}").alias(c) for c in columns])


#: So many pairs are looked at together.
PAIRS = 1 << 20


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of these sizes that follow one another, about PAIRS at once; the rows of a pair in their order."""
    ends = np.cumsum(sizes)
    later = np.repeat(ends, sizes) - 1 - np.arange(ends[-1] if len(ends) else 0)  # rows of the group that come after each
    upto = np.cumsum(later)
    first = 0
    while first < len(later):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(first, last), later[first:last])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[first:last]) - later[first:last], later[first:last])
        first = last


def _flat(batch: pa.RecordBatch, column: int) -> pa.Array:
    return batch.column(column).flatten()


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of all groups of a batch: group, class, home, and the block where the group is two blocks, else a number of its own."""
    sizes = np.diff(np.asarray(batch.column(3).offsets))
    group = np.repeat(np.arange(batch.num_rows), sizes)
    two = (batch.column(1).to_numpy() != batch.column(2).to_numpy())[group]
    own = np.where(two, _flat(batch, 5).to_numpy(), -1 - np.arange(len(group)))
    return group, _flat(batch, 3).to_numpy(), _flat(batch, 4).to_numpy(zero_copy_only=False), own


def _likely(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """(cell, class, home) of what has another in its cell with few enough different signs. Of the pairs of a cell one row is at home; of a group of two blocks they are of both."""
    for batch in batches:
        group, classes, home, own = _asked(batch)
        words = np.frombuffer(b"".join(_flat(batch, 6).to_pylist()), np.uint64).reshape(len(classes), -1)
        stay = np.zeros(len(classes), bool)
        for a, b in _pairs(np.bincount(group, minlength=batch.num_rows)):
            open_ = np.flatnonzero((home[a] | home[b]) & (own[a] != own[b]))
            a, b = a[open_], b[open_]
            near = sum((np.bitwise_count(w[a] ^ w[b]) for w in words.T), np.zeros(len(a), np.uint16)) <= apart
            stay[a[near]] = stay[b[near]] = True
        at = pa.array(np.flatnonzero(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(group[stay])), pa.array(classes).take(at), pa.array(home).take(at)], names=["cell", "class", "home"])


def _before(looks_a: np.ndarray, looks_b: np.ndarray, cell: int) -> np.ndarray:
    """Whether pairs (pairs x tables x looks each) meet somewhere before the cell: in an earlier table, or in the same table in the cell of the smaller name."""
    first = np.full(len(looks_a), np.iinfo(np.int64).max)
    where = np.full(len(looks_a), np.iinfo(np.int64).max)
    for t in range(looks_a.shape[1] - 1, -1, -1):
        a, b = looks_a[:, t], looks_b[:, t]
        for met, name in (((a == b[:, :1]).any(1), b[:, 0]), ((b == a[:, :1]).any(1), a[:, 0])):
            where = np.where(met & ((first != t) | (name < where)), name, where)
            first = np.where(met, t, first)
    return where != cell


def _linked(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(class, linked, root): how many rows each class of a group is linked with here, and the smallest class that links in the group reach from it."""
    for batch in batches:
        group, classes, home, own = _asked(batch)
        sizes, vs, cells_ = _flat(batch, 6).to_numpy(), _flat(batch, 7).to_pylist(), batch.column(0).to_numpy()
        looks = np.frombuffer(b"".join(_flat(batch, 8).to_pylist()), np.int64).reshape(len(classes), plan.tables, plan.settings.looks)
        ends = np.searchsorted(group, np.arange(batch.num_rows + 1))
        for g, (lo, hi) in enumerate(itertools.pairwise(ends)):
            yield _linked_in_group(classes[lo:hi], home[lo:hi], own[lo:hi], sizes[lo:hi], vs[lo:hi], looks[lo:hi], int(cells_[g]), plan.settings.cosine)


def _linked_in_group(classes: np.ndarray, home: np.ndarray, own: np.ndarray, sizes: np.ndarray, vs: list[bytes], looks: np.ndarray, cell: int, cosine: float) -> pa.RecordBatch:
    asked = np.triu((home[:, None] | home[None, :]) & (own[:, None] != own[None, :]), 1)
    counts, root = np.zeros(len(classes), np.int64), np.arange(len(classes))
    for at, v in _by_length(vs):
        a, b = np.nonzero(asked[np.ix_(at, at)] & (_cosines(v) >= cosine))
        for lo in range(0, len(a), 1 << 14):
            x, y = at[a[lo : lo + (1 << 14)]], at[b[lo : lo + (1 << 14)]]
            new = ~_before(looks[x], looks[y], cell)
            x, y = x[new], y[new]
            np.add.at(counts, x, sizes[y])
            np.add.at(counts, y, sizes[x])
            root = _joined(root, x, y)
    found = np.flatnonzero(counts)
    least = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, classes)
    return pa.RecordBatch.from_arrays([pa.array(classes[found]), pa.array(counts[found]), pa.array(least[root[found]])], names=["class", "linked", "root"])


def _cosines(v: np.ndarray) -> np.ndarray:
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    v = np.ldexp(v, -exponent[:, None])
    norms = np.sqrt((v * v).sum(1))
    return (v @ v.T) / (norms[:, None] * norms[None, :])


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots (of rows 0 to n - 1) after pairs of rows are joined: labels fall to the smallest until nothing changes."""
    while True:
        low = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(low, root[x], least)
        np.minimum.at(low, root[y], least)
        low = low[low[root]]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: B008
    """(id, n_links, component_id, kept, class_id, row_no) for every row.

    n_links counts the other rows linked directly, by a cosine of at least settings.cosine; component_id is the smallest id that links reach, kept marks it, class_id is
    the smallest id of equal vectors. Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, nor do vectors of
    different lengths with each other. Repeated rows are rows of their own, linked if their vectors can be. A row without id counts as a row; its component's id is the smallest there is,
    null if none is. An empty table gives an empty result. A pair just similar enough is missed with a chance of settings.missed (one in a million); no pair is found wrongly.
    """
    folder = shared_dir(vectors.sparkSession)
    v = F.col("v")
    plain = document_columns(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = numbered(plain.withColumn("v", F.when(finite(v) & F.exists(v, lambda x: x != 0), v)), path=f"{folder}/rows")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("row_no").alias("class"), F.count(F.lit(1)).alias("size"), F.min("id").alias("class_id"))
    classes = stored(as_bytes(classes.withColumn("name", F.sha2(_text(v), 256))), f"{folder}/classes")
    plan = Plan.of(classes.count(), settings)
    looked = stored(classes.select("class", "v").mapInArrow(lambda b: _looked(b, plan), "cell long, class long, home boolean, sketch binary"), f"{folder}/looked")
    likely = _grouped(_dealt(looked, settings.block), "sketch").mapInArrow(lambda b: _likely(b, plan.apart), "cell long, class long, home boolean")
    likely = stored(likely.distinct(), f"{folder}/likely")
    few = classes.join(likely.select("class").distinct(), "class", "left_semi").select("class", "size", "v")
    few = stored(few.mapInArrow(lambda b: _with_looks(b, plan), "class long, size long, v binary, looks binary"), f"{folder}/few")
    held = stored(join_spread(likely, few, ["class"]), f"{folder}/held")
    found = stored(_grouped(_dealt(held, settings.block), "size", "v", "looks").mapInArrow(lambda b: _linked(b, plan), "class long, linked long, root long"), f"{folder}/linked")
    roots = components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct(), folder)
    links = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    told = classes.select("class", "size", "class_id", "name").join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    told = stored(told.select("class", "name", "class_id", "root", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links")), f"{folder}/told")
    least = stored(told.groupBy("root").agg(F.min("class_id").alias("component_id")), f"{folder}/least")
    told = stored(join_spread(told, least, ["root"]).drop("root", "class"), f"{folder}/classes-told")
    named = stored(rows.select("id", "row_no", F.sha2(_text(v), 256).alias("name")), f"{folder}/named")
    joined = join_spread(named.where("name is not null"), told, ["name"]).drop("name").unionByName(
        named.where("name is null").select("id", "row_no", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    )
    return joined.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id", "row_no")


def _text(v: Column) -> Column:
    """A text that equal vectors have in common and others don't; 0 and -0 are equal."""
    return F.array_join(F.transform(v, lambda x: (x + F.lit(0.0)).cast("string")), ",")
