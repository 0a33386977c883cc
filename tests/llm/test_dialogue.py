"""Repair of conversations against an exhaustive search and a plain recursion over whole texts."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from weftline.llm import dialogue, queries

GOOD = re.compile(r"(s?(ua)+)?")
PRICE = {"K": 0, "R": 3, "D": 4, "I": 3}
GIVEN = {"u": "user", "a": "assistant"}
ROWS = "conv_id long, turn long, role string, text string, pos int, key string"


def exhaustive(letters):
    """(cost, audit) over all edits of a few rows, with at most two inserts in a place."""
    inserts = ["", "u", "a", "ua", "au", "uu", "aa"]
    per_row = [[("D", "", 4)] if c == "X" else [("D", "", 4), *([("K", c.lower(), 3 * c.isupper())] if c.lower() in "sua" else [("K", "?", 0)]), *(("R", x, 3 + 3 * c.isupper()) for x in "ua")] for c in letters]
    best = None
    for own in itertools.product(*per_row):
        for more in itertools.product(inserts, repeat=len(letters) + 1):
            roles = "".join(a + b[1] for a, b in zip(more, own, strict=False)) + more[-1]
            if GOOD.fullmatch(roles):
                cost = sum(b[2] for b in own) + 3 * sum(map(len, more))
                audit = "".join("I" * len(a) + b[0] for a, b in zip(more, own, strict=False)) + "I" * len(more[-1])
                best = min(best or (cost, audit), (cost, audit))
    return best


def answer(letters):
    edits, behind = dialogue.solved(letters, dialogue.ENDED, dialogue.START)
    edits = (*edits, dialogue.automaton().tail[behind])
    return dialogue.cost_of(letters, edits), "".join(e[::2] for e in edits)


def test_all_short_signatures():
    short = [c for n in (1, 2) for c in itertools.product(dialogue.LETTERS, repeat=n)]
    longer = ["sss", "uuu", "aaa", "aus", "UAX", "oXa", "sus", "auX", "SUA", "oOo", "uXa", "usa", "XXX", "asu", "aSa", "sua"]
    for letters in [*map("".join, short), *longer]:
        assert answer(letters) == exhaustive(letters), letters


def recursion(rows):
    """(cost, audit, repaired) of rows (letter, role, text), by plain recursion on texts."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, before, inserts=2):
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        for x in after[before]:
            if x in "ua" and inserts:
                c, t, e = best(i, x, inserts - 1)
                options.append((3 + c, "I" + t, (("I", GIVEN[x]), *e)))
        if i < len(rows):
            letter = rows[i][0]
            c, t, e = best(i + 1, before)
            options.append((4 + c, "D" + t, e))
            for x in after[before] if letter != "X" else ():
                kept = letter.lower() == x
                if kept or x in "ua":
                    c, t, e = best(i + 1, x)
                    options.append((c + 3 * letter.isupper() + 3 * (not kept), ("K" if kept else "R") + t, ((i, rows[i][1] if kept else GIVEN[x]), *e)))
        return min(options, default=(1e9, "", ()))

    for i in range(len(rows), -1, -1):  # else the recursion is as deep as the conversation is long
        for before in after:
            best(i, before)
    cost, audit, edits = best(0, "")
    return cost, audit, [(role, "" if i == "I" else rows[i][2]) for i, role in edits]


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def tie(row):
    return hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()


def audited(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, tie(r)))
        seen, letters, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters.append(("X" if fault in (0, 1) else known.upper() if fault == 2 else known, role, text))
        initials = [r[2][:1] or " " for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, repaired = recursion(tuple(letters))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, sha))
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def got_of(df):
    return ordered(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_of(queries.QUERIES["op13_dialogue"](spark, sf)) == ordered(audited(rows, spoiled(rows)))


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS).repartition(parts)


@pytest.mark.parametrize("bits", [1, 3])
def test_conversations_of_many_pieces(spark, monkeypatch, bits):
    """Pieces of a few rows: every conversation is put together of many, in several runs, and the longest is hashed over chunks."""
    monkeypatch.setattr(dialogue, "PIECE_BITS", bits)
    monkeypatch.setattr(dialogue, "CHUNK", 100)
    random.seed(3)
    words = ["Yes.", "No", " ", "", "Why?", "é…", "a\nb!", "same."]
    lengths = [0, 1, 2, 3, 7, 40, 41, 300]
    rows = [(i, None if random.random() < 0.1 else j // 2 if random.random() < 0.2 else j, random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unicorn"]), random.choice(words) + (str(j) + random.choice(".!x") if j % 3 else "")) for i, n in enumerate(lengths) for j in range(n)]
    turns = frame(spark, rows)
    plain = [(a, b, " " if c is None else c, d) for a, b, c, d in rows]
    assert got_of(dialogue.audited(turns, dialogue.repair(turns))) == ordered(audited(rows, plain))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, None, None, None), (2, 5, "user", "x" * 300_000 + ". "), (2, 3, "assistant", "y" * 2_000_000 + "! \n\t"), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "user", "same."), (4, -5, "system", "s."), (4, 9, "", "t.")]
    turns = frame(spark, rows)
    plain = [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]
    assert got_of(dialogue.audited(turns, dialogue.repair(turns))) == ordered(audited(rows, plain))
    none = frame(spark, [])
    assert got_of(dialogue.audited(none, dialogue.repair(none))) == []
    spoilt = dialogue.damaged(turns)
    assert got_of(dialogue.audited(turns, dialogue.repair(spoilt))) == ordered(audited(rows, spoiled(rows)))


def test_what_is_left_of_nothing(spark):
    """A conversation that is dropped whole has zeros, no audit and the hash of nothing."""
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = frame(spark, [(dropped, 0, "user", "a.")])
    assert got_of(dialogue.audited(turns, dialogue.repair(dialogue.damaged(turns)))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_a_hot_conversation(spark):
    """One conversation holds most rows; equal rows of it are dealt out as well."""
    rows = [(7, 0 if i % 2 else i, "user" if i % 3 else "assistant", "same." if i % 2 else f"t{i}.") for i in range(900)] + [(i, 0, "user", "u.") for i in range(20)]
    turns = frame(spark, rows)
    assert got_of(dialogue.audited(turns, dialogue.repair(turns))) == ordered(audited(rows, rows))
