"""Operators on texts against brute force, on small planted tables and on whole small ones."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import langid, licenses, minhash, mixing, packing, tokenfile, tokens, toxicity
from weftline.llm.shared import SpanHasher, slices, stored, word_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_no int, score double, size string, class long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"word{i}" for i in range(6000))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; with columns whose names operators use themselves."""
    texts = [None, "", " \t\n", "one", "one two three", "a b c d e f g h i j", "a b c d e f g h i j", "A B c d E f g h i j", LONG, LONG + " x", "été 日本語 ñandú", "1234 5678 !!", "Released under the MIT License. mit license"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, i, 0.5, "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "nobody's text", None, None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def known(docs):
    return {r["doc_id"]: r for r in docs.collect()}


# mixing -----------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by water filling, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing_whole_table(spark, docs, known):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in known.values():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets, taken = filled(sizes), Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(known[r["doc_id"]]["text"] or ""))
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["copies"] - r["epochs"] in (0, 1)
        taken[r["source"]] += r["taken"]
    assert len(got) == len(known)
    for s, n in taken.items():
        assert abs(n - targets[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix(docs).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixing_follows_keys(spark):
    docs = spark.createDataFrame([(i, "w " * 10 + ("x" if i % 2 else "1234567890"), "s") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.5).collect()
    chosen = Counter(r["doc_id"] % 2 for r in got if r["copies"])
    assert abs(sum(r["taken"] for r in got) - 0.5 * sum(r["size"] for r in got)) <= 11
    assert chosen[1] > chosen[0]  # heavier documents come first more often


def test_mixing_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(i if i % 2 else None, "w " * 10, "s") for i in range(2000)], "doc_id long, text string, source string")
    taken = Counter(r["doc_id"] is None for r in mixing.mix(docs, share=0.5).collect() if r["copies"])
    assert abs(taken[True] - 500) < 90
    assert abs(taken[False] - 500) < 90


def test_mixing_of_rows_without_ids_reruns(spark, tmp_path, monkeypatch):
    """The same files read in other pieces give the same mix; equal rows are told apart only by how many of them are taken."""
    rows = [(None if i % 3 else i, f"{'w ' * (i % 7)}{i % 50}", "ab"[i % 2] if i % 11 else None) for i in range(6000)]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    mixes, bits = [], [mixing.OCCURRENCE_BITS, 3]
    for size, few in (("128m", bits[0]), ("4k", bits[1])):
        monkeypatch.setattr(mixing, "OCCURRENCE_BITS", few)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        mixes.append(Counter((r["doc_id"], r["size"], r["source"], r["taken"], r["copies"]) for r in mixing.mix(spark.read.parquet(path), share=0.7).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert mixes[0] == mixes[1]
    assert len({c for (d, _, _, _, c) in mixes[0] if d is None}) == 2  # some are taken, some aren't


def test_occurrences(spark, monkeypatch):
    monkeypatch.setattr(mixing, "OCCURRENCE_BITS", 3)
    rows = stored(spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(500)], "row_no long, digest string").repartition(4))
    got = sorted(tuple(r) for r in mixing.with_occurrence(rows, "digest", "row_no", "n").select("digest", "row_no", "n").collect())
    seen, want = Counter(), []
    for i in range(500):
        want.append(("ab"[i % 3 == 0], i, seen[i % 3 == 0]))
        seen[i % 3 == 0] += 1
    assert got == sorted(want)


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0


# near-duplicates --------------------------------------------------------------------------------------------------


def shingle_set(text, words):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def grouped(texts, words):
    """Smallest id reachable over links, by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t, words) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for a, b in {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[:i]}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, sets


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_whole_table(docs, known, words):
    want, sets = grouped({d: r["text"] for d, r in known.items()}, words)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, minhash.Settings(words=words)).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(s) and got[d]["kept"] == (want[d] == d) for d, s in sets.items())


def test_near_copies_chains_and_shared_passages(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts, passage = {}, " ".join(f"p{i}" for i in range(60))
    for i in range(60):  # copies with a few changed words: some link only through others
        copy = list(base)
        for at in rng.choice(120, rng.integers(0, 12), replace=False):
            copy[at] = f"x{i}{at}"
        texts[i] = " ".join(copy)
    for i in range(60, 120):
        texts[i] = passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    stored = minhash.stored(docs)
    want, _ = grouped(texts, 4)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(stored, minhash.Settings(words=4)).collect()} == want


def test_near_duplicates_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(minhash.stored(odd), minhash.Settings(words=4)).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["n_shingles"] for r in by_id[0] + by_id[1] + by_id[2]] == [0, 0, 0]
    assert all(r["component_id"] == r["doc_id"] for i in (0, 1, 2, 3, 4) for r in by_id[i])
    assert {r["component_id"] for i in (5, 6, 7) for r in by_id[i]} == {5}
    assert by_id[9][0]["component_id"] == 8
    assert minhash.near_duplicates(none).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        s = minhash.super_minhash(np.repeat([0, 1], 90), np.concatenate([x, y]), 2, 96)
        errors.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.03
    assert np.std(errors) < 0.045


def test_super_minhash_of_few_elements():
    one = minhash.super_minhash(np.zeros(1, np.int64), np.array([5], np.uint64), 1, 16)
    ranks = sorted((one[0] >> np.uint64(56)).tolist())
    assert ranks == list(range(16))  # a lone element takes every place once, in the order of its permutation


# tokens, packing, files -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


NASTY = ["", " ", "\n\nb", "a\n\n\tb", "a\u00a0\nb", "\nb", "é\nb", "x \nb", "  a  b ", "it's I'LL 'sup", "a\n\nb\n c\t\td", "x1y2 3.14", "été œuvre straße ÀÉ×÷", "日本語 テスト", "emoji 🎉🎉 end", "a b c", "<|endoftext|> ok", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|><|endoftext|>\n\nc", "<|endoftext|", "<<|endoftext|>|endoftext|>", "x. <|endoftext|>", "...!!! ???", "a" * 3000, "\r\n\r\nx", "tab\tWord\nWord", "café́ ö", "don't\n'tis"]


def test_encoder_on_nasty_texts(tokenizer):
    import pyarrow as pa

    for rows, flat, begins in tokens.encoded(pa.array([*NASTY, None]), tokens.default_path()):
        for i in range(len(rows)):
            assert flat[begins[i] : begins[i + 1]].tolist() == ids_of(tokenizer, ([*NASTY, None])[rows.first + i])


def test_encoder_on_random_texts(tokenizer):
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab éÀ×'sL\n\t\r .,!-1٣  ̈日Ω"), max_size=12), min_size=1, max_size=4))
    def check(texts):
        for rows, flat, begins in tokens.encoded(pa.array(texts), tokens.default_path()):
            for i in range(len(rows)):
                assert flat[begins[i] : begins[i + 1]].tolist() == ids_of(tokenizer, texts[rows.first + i])

    check()


def test_encoder_on_random_texts_with_added_tokens(tokenizer):
    """Whole and broken added tokens among all that may stand beside one, also where two rows would make one up together."""
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    parts = st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "a", " ", "\n", "\t", ".", "é", "b c", "1", "日"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(parts, max_size=8).map("".join), min_size=1, max_size=4))
    def check(texts):
        for rows, flat, begins in tokens.encoded(pa.array(texts), tokens.default_path()):
            for i in range(len(rows)):
                assert flat[begins[i] : begins[i + 1]].tolist() == ids_of(tokenizer, texts[rows.first + i])

    check()


def test_added_tokens_that_mind_their_surroundings(tmp_path):
    """Tokens that take white space with them or stand alone only: such rows go to the library as they are."""
    import pyarrow as pa
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.add_tokens([AddedToken("<m>", lstrip=True, rstrip=True), AddedToken("word", single_word=True), AddedToken("plain")])
    t.save(str(tmp_path / "t.json"))
    texts = ["a. <m> \n b", "word words sword. word", "a word\nwordy", "plainly plain", "explain this.\nb", "a\nb <m>c"]
    for rows, flat, begins in tokens.encoded(pa.array(texts), str(tmp_path / "t.json")):
        for i in range(len(rows)):
            assert flat[begins[i] : begins[i + 1]].tolist() == ids_of(t, texts[rows.first + i])


def packed_as_they_should(rows, lengths_of, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_whole_table(docs, known, tokenizer):
    got = packing.pack_documents(docs).collect()
    ids = {d: ids_of(tokenizer, r["text"]) for d, r in known.items()}
    want = set()
    for d, own in ids.items():
        first = (len(own) - 1) % 1024 + 1
        cuts = [0, *range(first, len(own) + 1, 1024)]
        want |= {(d, n, a, b - a, crc(own[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = packed_as_they_should(got, None, 1024)
    assert sequences <= 1.03 * math.ceil(sum(map(len, ids.values())) / 1024) + 1


def test_plans_use_every_piece():
    rng = np.random.default_rng(3)
    for high in (5, 40, 200):
        counts = Counter(rng.integers(1, high + 1, 500).tolist())
        plan = packing.packing_plan(dict(counts), high)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= high
            for x in pattern:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in plan) <= 1.05 * sum(k * n for k, n in counts.items()) / high + 1
    assert packing.packing_plan({700: 5, 324: 3, 200: 2, 124: 2}, 1024) == [((700, 324), 3), ((700, 200, 124), 2)]
    assert packing.packing_plan({}, 10) == []


def test_index_of_sums():
    rng = np.random.default_rng(8)
    lengths = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 60), 14, replace=False), rng.integers(1, 3, 14), strict=True)}
    free = np.zeros(64, np.int64)
    for x, n in lengths.items():
        free[x] = n
    index = packing.SumIndex(lengths, 63)
    has = lambda combination: all(lengths.get(x, 0) >= n for x, n in Counter(combination).items())
    for gap in range(1, 64):
        pairs = [(a, gap - a) for a in range(gap - 1, 0, -1) if 2 * a >= gap and has((a, gap - a))]
        triples = [(a, b, gap - a - b) for a in range(gap, 0, -1) for b in range(min(a, gap - a - 1), 0, -1) if b >= gap - a - b and has((a, b, gap - a - b))]
        assert index.single(gap, free) == ((gap,) if has((gap,)) else None)
        assert index.pair(gap, free) == (pairs[0] if pairs else None)
        assert index.triple(gap, free) == (triples[0] if triples else None)


def test_packing_odd_rows(odd, none):
    got = packing.pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in got) == odd.count()
    packed_as_they_should(got, None, 1024)
    assert [r["length"] for r in got if r["doc_id"] in (0, 1)] == [1, 1]
    assert packing.pack_documents(none).count() == 0


def test_token_file_round_trip(docs, known, tokenizer):
    got = sorted(tokenfile.token_file(docs).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in got:
        want = ids_of(tokenizer, known[r["doc_id"]]["text"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(want), crc(want), want)
        start += len(want)


def test_token_file_odd_rows(spark, odd, none, tokenizer, tmp_path):
    got = tokenfile.token_file(odd).collect()
    want = Counter((r[0], tuple(ids_of(tokenizer, r[1]))) for r in odd_rows())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert min(got, key=lambda r: r["start"])["doc_id"] is None
    assert tokenfile.token_file(none, path=f"file://{tmp_path}/t").count() == 0


def test_token_file_of_extreme_ids(spark):
    rows = [(None, "a b"), (-(1 << 63), "c"), ((1 << 63) - 1, ""), (None, None)]
    got = tokenfile.token_file(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(1 << 63), (1 << 63) - 1]


def test_codes_of_large_vocabularies():
    n = 100_000
    rng = np.random.default_rng(9)
    lengths = tokenfile.code_lengths(rng.integers(1, 5, n), n.bit_length() + 1)
    ids = rng.integers(0, n, 500)
    book = tokenfile.Codebook(np.arange(n), lengths)
    assert book.decode([(*book.encode(ids), len(ids))])[0].tolist() == ids.tolist()


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    for n, bits in ((2, 3), (9, 4), (300, 16), (300, 9)):
        counts = rng.zipf(1.3, n).clip(1, 10**6)
        lengths = tokenfile.code_lengths(counts, bits)
        assert lengths.max() <= bits
        assert (0.5 ** lengths.astype(float)).sum() <= 1
        entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
        assert bits < 10 or (counts * lengths).sum() / counts.sum() <= entropy + 1
        ids = rng.choice(n, 1000, p=counts / counts.sum())
        ids[0] = 0
        book = tokenfile.Codebook(np.arange(n), lengths)
        payload, checkpoints = book.encode(ids)
        assert book.decode([(payload, checkpoints, len(ids)), (payload, checkpoints, len(ids))])[1].tolist() == ids.tolist()
    assert tokenfile.code_lengths(np.array([7])).tolist() == [1]
    with pytest.raises(ValueError, match="don't fit"):
        tokenfile.code_lengths(np.ones(9, int), 3)


# language, toxicity, licenses ---------------------------------------------------------------------------------------


def test_language_held_out(docs, known):
    got = langid.predict(docs).collect()
    assert len(got) == len(known)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_language_code_lengths(spark):
    """Costs of all bytes in a state are a distribution, and the bits of a text are the sum over its bytes."""
    docs = spark.createDataFrame([(i, "abracadabra " * 3, "x") for i in range(5)] + [(i, "hocus pocus " * 3, "y") for i in range(5, 9)], "doc_id long, text string, lang string")
    trees = langid.train(docs, states=40)
    p = np.exp2(-trees.cost.astype(float)).reshape(2, -1, 256)
    assert np.allclose(p.sum(2), 1, atol=1e-3)
    text = b"abra pocus"
    at = trees.walk(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    bits = trees.bits(at, np.array([0, len(text)]))[0]
    for k in range(2):
        state, want = 0, 0.0
        for b in text:
            want += trees.cost[k][state * 256 + b]
            state = int(trees.step[state, b])
        assert math.isclose(bits[k], want, rel_tol=1e-6)


def test_language_by_another_coder(spark):
    """Code lengths against prediction by partial matching as its definition says it, from counts of whole texts."""
    texts = {"x": ["abracadabra bra", "Cabra, abra!", "été"], "y": ["hocus pocus", "pocus abra hocus", "ça"]}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)], "doc_id long, text string, lang string")
    trees = langid.train(docs, states=100_000)
    low = lambda t: t.translate(LOW).encode()
    counts = {lang: {} for lang in texts}
    for lang, own in texts.items():
        for t in map(low, own):
            for i in range(len(t)):
                for k in range(min(i, langid.ORDER) + 1):
                    counts[lang].setdefault(t[i - k : i], Counter())[t[i]] += 1
    contexts = {t[i - k : i] for own in texts.values() for t in map(low, own) for i in range(len(t) + 1) for k in range(min(i, langid.ORDER) + 1)}

    def p(lang, context, byte):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        seen = counts[lang].get(context)
        if not seen:
            return p(lang, shorter, byte)
        left = 1 - sum(p(lang, shorter, b) for b in seen)
        escape = len(seen) / (seen.total() + len(seen))
        return seen[byte] / seen.total() * (1 - escape) if byte in seen else escape * p(lang, shorter, byte) / left

    for text in ("abra hocus", "Été ça?", "zzz"):
        t = low(text)
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(t)])
        got = trees.bits(trees.walk(data, offsets), offsets)[0]
        for k, lang in enumerate(trees.languages):
            want, context = 0.0, b""
            for byte in t:
                want -= math.log2(p(lang, context, byte))
                context = (context + bytes([byte]))[-langid.ORDER :]
                while context not in contexts:
                    context = context[1:]
            assert math.isclose(got[k], want, rel_tol=1e-4)


def test_strange_texts(spark, docs, known):
    """A Latin-script language that nobody taught stands out by its letters; figures, capitals and short texts don't."""
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    swahili = "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Kila mtu anastahili kuwa na haki zote."
    trees = langid.with_usual(docs, langid.train(docs))
    own = next(r["text"] for r in known.values() if r["lang"] == "en" and r["text"] and len(r["text"]) > 300)
    more = spark.createDataFrame([(-1, polish), (-2, swahili), (-3, own.upper() + " 0123456789abcdef " * 9), (-4, "日本"), (-5, None)], "doc_id long, text string")
    found = langid.identify(docs.select("doc_id", "text").union(more), trees, into=("lang", "score", "times"))
    times = {r["doc_id"]: r["times"] for r in found.collect()}
    assert min(times[-1], times[-2]) > 2.5
    assert times[-3] < 2
    assert times[-4] == times[-5] == 0
    assert max(t for i, t in times.items() if i >= 0) < 2.25


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd).collect()}
    assert [got[i] for i in (0, 1, 2, 11)] == ["und"] * 4
    assert got[5] == "en"
    assert langid.predict(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def two_words(n, label):
    """Texts of twelve common words, each of two words at random among them, and label(first, second)."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(n):
        insult, group = (rng.random(2) < 0.5).tolist()
        words = [f"filler{k}" for k in rng.integers(0, 200, 12)] + ["wretch"] * insult + ["townsfolk"] * group
        texts.append((i, " ".join(rng.permutation(words)), int(label(insult, group))))
    return texts


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a and b], ids=["either", "both"])
def test_toxicity_learns_pairs(spark, label):
    """Of exactly one of two words neither tells anything by itself."""
    rows = two_words(4000, label)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(table, table).where("held_out").collect()}
    assert sum(got[i] == want for i, _, want in rows if i in got) >= 0.95 * len(got) > 600


def test_toxicity_logits_by_brute_force():
    rng = np.random.default_rng(6)
    machine = toxicity.Machine(0.3, np.where(rng.random(toxicity.BUCKETS) < 0.5, rng.integers(1, 50, toxicity.BUCKETS), 0).astype(np.int32), np.append(0, rng.normal(size=49)), np.concatenate([np.zeros((1, 3)), rng.normal(size=(49, 3))]))
    texts = ["one two three four", "", "five five SIX sevenths", " ".join(f"w{i}" for i in range(60))]
    import pyarrow as pa

    (part,) = slices(pa.array(texts))
    row, bucket = toxicity.hashed_terms(part.data, part.offsets)
    got = machine.logits(row, bucket, len(texts))
    for i in range(len(texts)):
        own = [p for p in machine.place[bucket[row == i]].tolist() if p]
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for n, a in enumerate(own) for b in own[:n])
        assert math.isclose(got[i], 0.3 + sum(machine.weights[p] for p in own) + pairs / max(len(own), 1), rel_tol=1e-9)


def test_toxicity_of_rare_labels(spark):
    """One document in a hundred is toxic; the sample is balanced and the scores are not."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join([f"filler{k}" for k in rng.integers(0, 300, 15)] + ["knave"] * (i % 100 == 0)), int(i % 100 == 0)) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(table, table, training_rows=400)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, machine).collect()}
    toxic, clean = ([got[i] for i, _, want in rows if want == t] for t in (1, 0))
    assert min(toxic) > max(clean)
    assert abs(sum(got.values()) - 60) < 40  # the scores know that few are


def test_toxicity_held_out(spark, known, sf):
    path = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.predict(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    clean = [r for r in held if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    toxic, fine = ([r["score"] for r in held if r["toxic"] == t] for t in (1, 0))
    assert np.mean([a > b for a in toxic for b in fine]) > 0.8


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (8, None), (9, 0)], "doc_id long, toxic int")
    got = toxicity.predict(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(none, labels).count() == 0
    assert len({r["score"] for r in toxicity.predict(odd, labels.limit(0)).collect()}) == 1


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    w = LICENSE_WORD.findall((text or "").translate(LOW))
    found = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licenses_whole_table(docs, known):
    for r in licenses.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == places(known[r["doc_id"]]["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_notices(spark):
    end = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = [f"the terms of the GNU {name} {end.format(v)}" for name, v in (("General Public License", "2"), ("Lesser General Public License", "2.1"), ("Affero General Public License", "3"))]
    texts.append("GNU General Public License as published by the Free Software Foundation, version 2")
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i][0] - {"gpl"} for i in range(4)] == [{"gpl-2", "gpl-or-later"}, {"lgpl-2.1", "lgpl-or-later"}, {"agpl-3", "agpl-or-later"}, {"gpl-2"}]
    assert {s for _, s in got.values()} == {0.98}


def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the", "GNU Lesser General Public License v2.1 or any later version", "mit license MIT LICENSE x mit license", "CC BY-NC-SA 4.0", "SPDX-License-Identifier: Apache-2.0", "nothing here", "may mit license" + " pad" * 3000 + " cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["labels"] == "apache,apache-2.0"
    assert got[1]["labels"] == "lgpl-2.1,lgpl-or-later"
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (3, 0, 5)
    assert got[3]["labels"] == "cc-by,cc-by-nc-sa-4.0"
    assert got[4]["labels"] == "spdx-apache-2-0"
    assert (got[5]["labels"], got[5]["score"]) == ("", 0.0)
    assert (got[6]["first_word"], got[6]["last_word"]) == (1, 3003)
    assert len(licenses.signature_rules()) > 200


def labelled(text):
    """Labels and score of a text by trying every rule at every place and every pair of what they find."""
    w = LICENSE_WORD.findall((text or "").translate(LOW))
    line = " " + " ".join(w) + " "
    found = []
    for rule, label, keyword, pattern, priority, confidence, base in licenses.signature_rules():
        if f" {keyword} " in line:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
                first = line[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), priority, rule, label, confidence, base))

    def hidden(a):
        return any(b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:2] != a[:2] or (b[2], -b[3]) > (a[2], -a[3])) for b in found)

    kept = [a for a in found if a[6] or not hidden(a)]
    return ",".join(sorted({a[4] for a in kept})), max((a[5] for a in kept), default=0.0)


def test_license_labels_by_brute_force(spark, docs, known):
    texts = {r["doc_id"]: r["text"] for r in known.values()}
    texts |= dict(enumerate(["GNU GPL v2 or later, the MIT License; cc by-sa 3.0", "BSD 3-Clause License. Apache License 2.0. GNU General Public License version 3 or any later version", "mpl 2.0 mpl 1.1 cc0 1.0 Creative Commons Attribution NonCommercial 4.0", "redistribution and use in source and binary forms with or without modification"], -10))
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(table).collect()}
    assert got == {i: labelled(t) for i, t in texts.items()}


def test_licenses_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert [(got[i]["n_words"], got[i]["labels"]) for i in (0, 1, 2)] == [(0, "")] * 3
    assert got[12]["n_base"] == 2
    assert licenses.scan(none).count() == 0


# shared helpers -----------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a b", None, "", "  a\tbb ", "b"]
    (part,) = slices(pa.array(texts))
    starts, ends, row = word_spans(part.data, part.offsets)
    words = [part.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert list(zip(row.tolist(), words, strict=True)) == [(0, "a"), (0, "b"), (3, "a"), (3, "bb"), (4, "b")]
    h = SpanHasher(part.data).spans(starts, ends)
    assert (h[0] == h[2], h[1] == h[4], len(set(h.tolist()))) == (True, True, 3)
    assert [len(p) for p in slices(pa.array(["x" * 50] * 4), 60)] == [1, 1, 1, 1]
    assert list(slices(pa.array([], pa.string()))) == []


# long texts -------------------------------------------------------------------------------------------------------


def test_texts_of_megabytes(spark, tokenizer):
    """Whole texts of two megabytes, near copies, one word of a hundred thousand letters, other scripts: through every operator on documents."""
    import random

    random.seed(6)
    words = ["".join(random.choices(string.ascii_lowercase, k=random.randint(2, 9))) for _ in range(5000)]
    first = random.choices(words, k=330_000)
    second = list(first)
    for at in random.sample(range(len(first)), 300):
        second[at] = "other"
    texts = {1: " ".join(first), 2: " ".join(second), 3: "".join(random.choices(string.ascii_lowercase, k=100_000)), 4: "日本語 テスト\n" * 80_000 + "Apache License."}
    assert len(texts[1].encode()) > 2_000_000
    docs = spark.createDataFrame([(i, t, "en" if i < 3 else "ja", "s", i) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    near = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(docs, minhash.Settings(words=4)).collect()}
    assert near == {i: (1 if i == 2 else i, len(shingle_set(t, 4))) for i, t in texts.items()}
    ids = {i: ids_of(tokenizer, t) for i, t in texts.items()}
    pieces = packing.pack_documents(docs).collect()
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in pieces), Counter())
    assert {(r["doc_id"], r["ids_crc32"]) for r in pieces} == {(i, crc(x[a:b])) for i, x in ids.items() for a, b in zip([0, *range((len(x) - 1) % 1024 + 1, len(x), 1024)], [*range((len(x) - 1) % 1024 + 1, len(x) + 1, 1024)], strict=True)}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_file(docs, with_ids=False).collect()} == {(i, len(x), crc(x)) for i, x in ids.items()}
    scanned = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert scanned[4]["base_labels"] == "apache"
    assert scanned[1]["n_words"] == 330_000
    told = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    assert {i: r["lang_pred"] for i, r in told.items() if not r["held_out"]} == {i: "en" if i < 3 else "ja" for i, r in told.items() if not r["held_out"]}
    scores = toxicity.predict(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert all(0 <= r["score"] <= 1 for r in scores)
    assert len(scores) == 4
