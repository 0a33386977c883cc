"""Repair of conversations by the cheapest edits, each distinct signature solved once.

The rows of a conversation become a string of one letter a row: its role, whether its text is broken off, or that it has to go. Rows are sorted and numbered
by Spark, and a string is cut after every 2 ** PIECE_BITS numbers, so no conversation is a task of its own. What the rest of a conversation costs from each role before it,
and which of equally cheap edits come first, are one of a few states; a piece turns the state behind it into the state before it. So pieces are composed like functions:
a conversation of many pieces is summed up by runs of neighbours and then by these runs, after which every piece knows the state behind it and the role before it.

Each distinct (piece, state, role) is then solved once, by memoised recursion on its halves; its edits are joined back to all conversations that have it and
replayed on their rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import document_columns, join_spread, numbered, shared_dir, stored

#: White space of the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a piece at most, a power of two; a run is what one task of the sort numbered.
PIECE_BITS = 8
_RUN_BITS = 33
#: What replayed text is hashed in, in bytes.
CHUNK = 256 << 10
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
#: Roles before a row: none yet, then by initial. Where each role may follow.
START, ROLES = 0, {"s": 1, "u": 2, "a": 3}
_FOLLOWS = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
#: Letters of rows: a role or another one (o), in capitals where the text is broken off; X has to go.
LETTERS = "suaoSUAOX"
ENDED = 0


@dataclass(frozen=True)
class Automaton:
    """States of a rest of rows. before: by letter and state behind a row the state before it; edits: by letter, state behind and role before, what is done up to
    and with the row, as pairs of an edit and the role that comes of it, and the role behind; tail: by role, what is inserted at the end."""

    before: dict[str, bytes]
    edits: dict[str, list[list[tuple[str, int]]]]
    tail: list[str]

    @property
    def states(self) -> int:
        return len(self.before["X"])


def _settled(options: list[list[tuple]]) -> list[tuple]:
    """By role the best of its options (cost, text key, edits, role behind), also after inserting."""
    best = [min(own, default=(float("inf"), ())) for own in options]
    while True:
        better = list(best)
        for role, at in ROLES.items():
            if role in "ua":
                for q in _FOLLOWS[role]:
                    if best[at][0] < float("inf"):
                        cost, key, edits, behind = best[at]
                        better[q] = min(better[q], (cost + INSERT, ("I", *key), f"I{role}{edits}", behind))
        if better == best:
            return best
        best = better


def _state(best: list[tuple]) -> tuple:
    """Costs above the least, and the places of the texts among each other."""
    order = sorted({b[1] for b in best})
    least = min(b[0] for b in best)
    return tuple(b[0] - least for b in best), tuple(order.index(b[1]) for b in best)


def _row(letter: str, costs: tuple, places: tuple) -> list[list[tuple]]:
    """By role before a row, what may be done with it."""
    options: list[list[tuple]] = [[(DELETE + costs[q], ("D", places[q]), "D-", q)] for q in range(4)]
    if letter == "X":
        return options
    own, broken = letter.lower(), BROKEN if letter.isupper() else 0
    for role, at in ROLES.items():
        for q in _FOLLOWS[role]:
            if own == role:
                options[q].append((KEEP + broken + costs[at], ("K", places[at]), f"K{role}", at))
            elif role in "ua":
                options[q].append((REROLE + broken + costs[at], ("R", places[at]), f"R{role}", at))
    return options


@functools.cache
def automaton() -> Automaton:
    """All states that rows lead to from the end, which is state 0."""
    ended = _settled([[(0, (), "", 0)], [], [], [(0, (), "", 3)]])
    states, before, edits = [_state(ended)], {c: [] for c in LETTERS}, {c: [] for c in LETTERS}
    for state in states:  # grows
        for c in LETTERS:
            best = _settled(_row(c, *state))
            if (found := _state(best)) not in states:
                states.append(found)
            before[c].append(states.index(found))
            edits[c].append([(b[2], b[3]) for b in best])
    return Automaton({c: bytes(x) for c, x in before.items()}, edits, [b[2] for b in ended])


def _half(n: int) -> int:
    """The largest power of two below n: pieces that begin alike have halves in common."""
    return 1 << ((n - 1).bit_length() - 1)


@dataclass(frozen=True)
class Step:
    """What a piece does: before, by the state behind it the state before it; behind, by the state behind and the role before (4 each) the role behind."""

    before: bytes
    behind: bytes

    def then(self, after: Step) -> Step:
        """This piece and one after it."""
        before = bytes(self.before[d] for d in after.before)
        behind = bytes(after.behind[4 * d + self.behind[4 * after.before[d] + q]] for d in range(len(before)) for q in range(4))
        return Step(before, behind)


@functools.lru_cache(maxsize=1 << 14)
def step(signature: str) -> Step:
    if len(signature) == 1:
        a = automaton()
        return Step(a.before[signature], bytes(a.edits[signature][d][q][1] for d in range(a.states) for q in range(4)))
    at = _half(len(signature))
    return step(signature[:at]).then(step(signature[at:]))


@functools.lru_cache(maxsize=1 << 14)
def solved(signature: str, state: int, role: int) -> tuple[tuple[str, ...], int]:
    """The edits of each row of a piece (pairs of an edit and the role that comes of it), and the role behind it; state: behind it, role: before it."""
    if len(signature) == 1:
        edits, behind = automaton().edits[signature][state][role]
        return (edits,), behind
    at = _half(len(signature))
    left, right = signature[:at], signature[at:]
    edits, role = solved(left, step(right).before[state], role)
    more, role = solved(right, state, role)
    return edits + more, role


def cost_of(signature: str, edits: tuple[str, ...]) -> int:
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    return sum(sum(price[e] for e in own[::2]) + (BROKEN if c.isupper() and c != "X" and "D" not in own else 0) for c, own in zip(signature, edits, strict=False)) + (INSERT * len(edits[-1]) // 2 if len(edits) > len(signature) else 0)


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, state, role, edits, audit, cost); behind the last piece of a conversation stands what is inserted at its end."""
    for batch in batches:
        out = []
        for signature, state, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            edits, behind = solved(signature, max(state, ENDED), role)
            edits = (*edits, automaton().tail[behind]) if state < 0 else edits  # -1: the end, with its inserts
            out.append({"signature": signature, "state": state, "role": role, "edits": list(edits), "audit": "".join(e[::2] for e in edits), "cost": cost_of(signature, edits)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("signature", pa.string()), ("state", pa.int32()), ("role", pa.int32()), ("edits", pa.list_(pa.string())), ("audit", pa.string()), ("cost", pa.int64())]))


_SOLUTION = "signature string, state int, role int, edits array<string>, audit string, cost long"
_LAST = -1


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [step(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.before for s in found], pa.binary()), pa.array([s.behind for s in found], pa.binary())], names=["signature", "before", "behind"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, run, before, behind, head, last) of a run's pieces (key, run, parts) in order."""
    for batch in batches:
        out = []
        for key, run, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = functools.reduce(Step.then, [Step(p["before"], p["behind"]) for p in parts])
            out.append((key, run, whole.before, whole.behind, parts[0]["head"], parts[-1]["last"]))
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["key", "run", "before", "behind", "head", "last"])


def _placed(parts: list[dict], state: int, role: int, previous: str | None) -> Iterator[tuple[int, int, str | None]]:
    """(state behind, role before, initial before) of each of some neighbours, given those of all of them."""
    states = []
    for p in reversed(parts):
        states.append(state)
        state = p["before"][max(state, ENDED)]
    for p, own in zip(parts, reversed(states), strict=True):
        yield own, role, previous
        role, previous = p["behind"][4 * max(own, ENDED) + role], p["last"]


def _runs_placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, run, state, role, previous) of the runs of each conversation."""
    for batch in batches:
        rows = [(key, p["run"], *own) for key, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p, own in zip(parts, _placed(parts, _LAST, START, None), strict=True)]
        yield _placed_rows(rows, "run")


def _pieces_placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, state, role, previous) of the pieces of each run."""
    for batch in batches:
        rows = [(key, p["block"], *own) for key, parts, *given in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p, own in zip(parts, _placed(parts, *given), strict=True)]
        yield _placed_rows(rows, "block")


def _placed_rows(rows: list[tuple], name: str) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", name, "state", "role", "previous"])


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _in_context(pieces: DataFrame, folder: str) -> DataFrame:
    """Stored pieces (key, block, n_pieces, signature, head, last, ...) with the state behind and the role before each, and whether it follows the piece before illegally (0 or 1)."""
    alone = pieces.where("n_pieces = 1").withColumn("state", F.lit(_LAST)).withColumn("role", F.lit(START)).withColumn("edge", F.lit(0))
    several = pieces.where("n_pieces > 1")
    if several.isEmpty():
        return alone
    several = stored(several, f"{folder}/several")
    steps = stored(several.select("signature").distinct().mapInArrow(_steps, "signature string, before binary, behind binary"), f"{folder}/steps")
    run = F.shiftright("block", _RUN_BITS - PIECE_BITS).alias("run")
    parts = F.array_sort(F.collect_list(F.struct("block", "before", "behind", "head", "last"))).alias("parts")
    runs = stored(join_spread(several.select("key", "block", "signature", "head", "last"), steps, ["signature"]).groupBy("key", run).agg(parts), f"{folder}/runs")
    composed = runs.mapInArrow(_composed, "key string, run long, before binary, behind binary, head string, last string")
    by_key = composed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", "before", "behind", "head", "last"))).alias("parts"))
    placed = stored(by_key.mapInArrow(_runs_placed, "key string, run long, state int, role int, previous string"), f"{folder}/placed-runs")
    within = runs.join(placed, ["key", "run"]).select("key", "parts", "state", "role", "previous")
    placed = stored(within.mapInArrow(_pieces_placed, "key string, block long, state int, role int, previous string"), f"{folder}/placed")
    told = several.join(placed, ["key", "block"]).withColumn("edge", F.coalesce(~_legal(F.col("previous"), F.col("head")), F.lit(False)).cast("int"))
    return alone.unionByName(told.drop("previous"))


@dataclass(frozen=True)
class Repaired:
    """audits: a row for each conversation (conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit), stored. turns: the repaired rows (key, block, pos, n, whole,
    role, text); in a partition those of a piece follow one another in order, whole tells whether the piece is the conversation."""

    audits: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Faults of conversations and the cheapest edits after which the initials of their roles are an s or none, then u and a by turns, or nothing.

    Rows go by turn, nulls first, those of one turn by a hash of role and text. A row's first fault counts: blank, duplicate (role and text were there before in the conversation),
    truncated (the last character that isn't white space is none of .!?). Keep costs 0, rerole to user or assistant 3, delete 4, which blank and duplicate rows need, insert an
    empty row of user or assistant 3, and truncated rows that stay 3 each. Of equally cheap edits those count whose initials come first. A null or empty role or text
    is one space or empty; a role of another initial can't be kept. Rows of null id are one conversation. Repeated rows are duplicates. An empty table has no conversations.
    """
    folder = shared_dir(turns.sparkSession)
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit(" ")), F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    plain = document_columns(turns, id_col, turn_col, role_col, text_col).select(conversation(F.col(id_col)).alias("key"), F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    salted = plain.withColumn("digest", digest).withColumn("salt", F.monotonically_increasing_id())  # equal rows, which may come in any order, are split among tasks as well
    rows = numbered(salted.orderBy("key", F.col("turn").asc_nulls_first(), "digest", "salt").drop("salt"), "pos", f"{folder}/rows")

    end = F.rtrim("text", F.lit(BLANKS))
    initial = F.when(role_initial(F.col("role")) == "", " ").otherwise(role_initial(F.col("role")))
    narrow = rows.select("key", "conv_id", "pos", initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    first = rows.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    seen = narrow.join(first, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    gone = F.col("blank") | F.col("duplicate")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(gone, "X").when(F.col("broken"), F.upper(known)).otherwise(known)
    truncated = ~gone & F.col("broken")
    listed = F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"), "initial"))).alias("rows")
    count = lambda c, name: F.count_if(c).alias(name)
    pieces = seen.groupBy("key", F.shiftright("pos", PIECE_BITS).alias("block")).agg(F.min("conv_id").alias("conv_id"), F.min("pos").alias("first_pos"), listed, count(F.col("blank"), "blank"), count(F.col("duplicate"), "duplicate"), count(truncated, "truncated"))
    initials = F.col("rows.initial")
    n = F.size("rows")
    illegal = F.size(F.filter(F.zip_with(F.slice(initials, 1, n - 1), F.slice(initials, 2, n), lambda a, b: F.coalesce(_legal(a, b), F.lit(True))), lambda ok: ~ok))
    pieces = pieces.select("key", "block", "conv_id", "first_pos", "blank", "duplicate", "truncated", F.array_join("rows.letter", "").alias("signature"), initials[0].alias("head"), F.element_at(initials, -1).alias("last"), illegal.alias("illegal"))
    pieces = stored(pieces, f"{folder}/pieces")
    sizes = stored(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n_pieces")), f"{folder}/sizes")
    placed = stored(_in_context(stored(join_spread(pieces, sizes, ["key"]), f"{folder}/sized"), folder), f"{folder}/contexts")
    solutions = stored(placed.select("signature", "state", "role").distinct().mapInArrow(_solutions, _SOLUTION), f"{folder}/solutions")
    answered = stored(join_spread(placed, solutions, ["signature", "state", "role"]), f"{folder}/answered")

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    total = lambda *names: F.sum(sum((F.col(x) for x in names[1:]), F.col(names[0]))).cast("long")
    sums = answered.groupBy("key").agg(F.min("conv_id").alias("conv_id"), total("blank").alias("blank"), total("duplicate").alias("duplicate"), total("truncated").alias("truncated"), total("illegal", "edge").alias("illegal"), total("cost").alias("cost"), audit.alias("audit"))
    turned = rows.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    audits = stored(sums.join(turned, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long")), f"{folder}/audits")
    return Repaired(audits, _replayed(rows, answered))


def conversation(conv_id: Column) -> Column:
    """A text for each conversation, also for that of null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def role_initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _replayed(rows: DataFrame, answered: DataFrame) -> DataFrame:
    """The edits of each piece, then its rows, meet in one task by key and block; rows pass by one after another."""
    none = lambda kind: F.lit(None).cast(kind)
    block = F.shiftright("pos", PIECE_BITS)
    edits = answered.select("key", "block", F.lit(-1).cast("long").alias("pos"), (F.col("n_pieces") == 1).alias("whole"), "edits", none("string").alias("role"), none("string").alias("text"))
    told = rows.select("key", block.alias("block"), "pos", none("boolean").alias("whole"), none("array<string>").alias("edits"), "role", "text")
    met = edits.unionByName(told).repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return met.mapInArrow(_replay, "key string, block long, pos long, n int, whole boolean, role string, text string")


#: The roles that rows are given.
_GIVEN = {"u": "user", "a": "assistant"}


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, edits, at = True, [], 0
    for batch in batches:
        out = []
        for key, block, pos, own_whole, own_edits, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_edits is not None:
                whole, at = own_whole, 0
                # what comes after the last row goes with it
                edits = own_edits if own_edits[-1][-2:-1] not in ("", "I") else [*own_edits[:-2], own_edits[-2] + own_edits[-1]]
                continue
            for n in range(0, len(edits[at]), 2):
                edit, given = edits[at][n], edits[at][n + 1]
                if edit == "I":
                    out.append((key, block, pos, n // 2, whole, _GIVEN[given], ""))
                elif edit != "D":
                    out.append((key, block, pos, n // 2, whole, role if edit == "K" else _GIVEN[given], text))
            at += 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["key", "block", "pos", "n", "whole", "role", "text"])


def digests(turns: DataFrame) -> DataFrame:
    """(key, sha256) of the repaired `role:text` of each conversation, joined by line feeds; none for a conversation without rows.

    Where a piece is the conversation it is hashed where it was replayed. Others are cut into chunks of CHUNK bytes, which one task passes through its hash in order: a hash has
    no other way.
    """
    folder = shared_dir(turns.sparkSession)
    cut = stored(turns.select("key", "block", "whole", "role", "text").mapInArrow(_hashed_or_cut, "key string, block long, chunk int, data binary, sha256 string"), f"{folder}/cut")
    alone = cut.where("data is null").select("key", "sha256")
    chunks = cut.where("data is not null").select("key", "block", "chunk", "data")
    return alone.unionByName(chunks.repartition("key").sortWithinPartitions("key", "block", "chunk").mapInArrow(_hashed, "key string, sha256 string"))


def _hashed_or_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each piece that is a conversation; of others chunks, in which a line feed stands before every row."""
    own, held, chunk, state = None, bytearray(), 0, None

    def closed() -> list[tuple]:
        if own is None:
            return []
        return [(own[0], own[1], None, None, state.hexdigest())] if state else [(own[0], own[1], chunk, bytes(held), None)]

    for batch in batches:
        out = []
        for key, block, whole, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            line = f"{role}:{text}".encode()
            if own != (key, block):
                out += closed()
                own, held, chunk, state = (key, block), bytearray(), 0, hashlib.sha256(line) if whole else None
                if whole:
                    continue
            if state:
                state.update(b"\n" + line)
                continue
            held += b"\n" + line
            while len(held) > CHUNK:
                out.append((key, block, chunk, bytes(held[:CHUNK]), None))
                held, chunk = held[CHUNK:], chunk + 1
        yield _chunk_rows(out)
    yield _chunk_rows(closed())


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", "block", "chunk", "data", "sha256"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, state = None, None
    kinds = (pa.string(), pa.string())
    for batch in batches:
        out = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            data = data.as_buffer()
            if key != own:
                out += [(own, state.hexdigest())] if state else []
                own, state = key, hashlib.sha256()
                data = memoryview(data)[1:]  # no line feed before the first row
            state.update(data)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["key", "sha256"])
    out = [(own, state.hexdigest())] if state else []
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["key", "sha256"])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults of known places, by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without .!?, twice, or from the user. A null
    role or text is one space, as is a null in that name."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = document_columns(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def audited(turns: DataFrame, repaired: Repaired) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of turns (conv_id), also of those that nothing is left of."""
    every = document_columns(turns, "conv_id").select(conversation(F.col("conv_id")).alias("key"), "conv_id").distinct()
    told = every.join(repaired.audits.drop("conv_id"), "key", "left").join(digests(repaired.turns), "key", "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
