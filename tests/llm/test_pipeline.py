"""The pipeline's stages on planted documents, and all of it on the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from weftline.llm import minhash, queries, tokens
from weftline.llm.shared import stored

from ..oracle import database, difference


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Five hundred documents of two languages, a fifth toxic by one word, beside copies and rubbish."""
    folder = tmp_path_factory.mktemp("sf")
    languages = {"en": "the of and to in is was for on are with they be at".split(), "fr": "le la les des une dans pour qui que sur avec est pas plus".split()}
    rows, labels = [], []
    for i in range(500):
        lang = "en" if i % 3 else "fr"
        words = [languages[lang][(i * 7 + k * k) % 14] + f"{chr(97 + (i * 31 + k * 17) % 26)}{chr(97 + (i + k) % 26)}" * (k % 3 == 0) for k in range(40)]
        if i % 5 == 0:
            words[i % 40] = "scoundrel"
        rows.append((i, " ".join(words), lang, f"s{i % 4}", None))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1001, rows[1][1], "en", "s1", None), (1002, rows[2][1] + " tail", "en", "s2", None), (1003, None, None, None, None), (1004, "", "en", "s0", 0), (1005, "12 34 !!", None, "s1", 8), rows[4]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, labelled):
    docs = spark.read.parquet(f"{labelled}/documents.parquet")
    kept = stored(pipeline.without_toxic(spark, docs, labelled))
    assert kept.columns == docs.columns
    assert not {r[0] for r in kept.select("doc_id").collect()} & set(range(0, 500, 5))
    assert kept.count() == docs.count() - 100
    spoken = stored(pipeline.in_a_language(spark, kept, labelled))
    assert {r[0] for r in kept.select("doc_id").subtract(spoken.select("doc_id")).collect()} == {1003, 1004, 1005}
    single = stored(pipeline.one_of_each_group(spark, spoken, labelled))
    assert {1001, 1002} & {r[0] for r in single.select("doc_id").collect()} == set()
    assert single.count() == single.select("doc_id").distinct().count()
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spoken).collect()}
    assert {r[0] for r in single.select("doc_id").collect()} == set(groups.values())
    mix = stored(pipeline.mixed(spark, single, labelled))
    assert mix.columns == docs.columns
    assert max(Counter(r[0] for r in mix.select("doc_id").collect()).values()) <= 2
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), " +")))).first()[0]
    assert abs(words(mix) - 1.5 * words(single)) < 45 * 4
    pieces = pipeline.packed(spark, mix, labelled)
    assert pieces.where("piece = 0").count() == mix.count()


def test_foreign_documents_go(spark, labelled):
    """A language in Latin letters that the corpus doesn't name is rejected; a short foreign note and codes among known words are not."""
    docs = spark.read.parquet(f"{labelled}/documents.parquet")
    foreign = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować."
    own = next(r["text"] for r in docs.where("doc_id = 1").collect())
    more = spark.createDataFrame([(2001, foreign), (2002, "Żółw"), (2003, own + " token = 9dd3c80004c73dc9e548fee51b23b527 +1 (706) 555-3138 " * 2), (2004, own.upper())], "doc_id long, text string")
    table = stored(docs.unionByName(more, allowMissingColumns=True))
    left = {r[0] for r in table.select("doc_id").subtract(pipeline.in_a_language(spark, table, labelled).select("doc_id")).collect()}
    assert left == {1003, 1004, 1005, 2001}


def test_stages_of_nothing(spark, labelled):
    docs = spark.read.parquet(f"{labelled}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, labelled).count() == 0


def test_columns_with_clashing_names(spark, labelled):
    docs = stored(spark.read.parquet(f"{labelled}/documents.parquet").limit(40).withColumns({n: F.lit(7) for n in ("score", "lang_pred", "row", "copies", "bits", "letter", "row_no")}))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, labelled)
        assert out.columns == docs.columns
        assert {r[0] for r in out.select("score").collect()} <= {7}


@pytest.mark.parametrize("stage", [pipeline.one_of_each_group, pipeline.mixed])
def test_joined_rows_are_numbered_once(spark, labelled, stage):
    """Numbers made in the plan that joins them would differ from those of an earlier read with other splits."""
    plan = stage(spark, spark.read.parquet(f"{labelled}/documents.parquet"), labelled)._jdf.queryExecution().analyzed().toString()
    assert "monotonically_increasing_id" not in plan


def test_run(spark, sf):
    from tokenizers import Tokenizer

    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(tokens.default_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    pieces, by_sequence = Counter(), {}
    for r in out.collect():
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():  # gapless from 0
        own.sort()
        assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    copies = {d: n for (d, piece, *_), n in pieces.items() if piece == 0}
    want = Counter()
    for d, n in copies.items():
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] = n
    assert pieces == want
    assert len(by_sequence) <= 1.03 * sum(n for own in by_sequence.values() for _, n in own) / 1024 + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert not difference(queries.QUERIES[name](spark, sf), database(sf), queries.ORACLE_SQL[name])
