"""License scans with ordered signature rules, all in DataFrame operations.

Texts are reduced to words; each rule is a regular expression over the words, gated by a keyword, with a
label, a priority and a confidence. Keywords are looked up in one pass over a text; only rules whose keyword occurs are tried, by
an equi-join with the rule table. Of overlapping detections, one that lies inside a detection of at least its priority
is suppressed; base rules are never suppressed.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import document_columns, row_id, stored

#: Phrases and labels that every scan reports wherever the words stand one after another.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_VERSION = "(?: (?:version|v|ver))?"
_OR_LATER = "(?: or(?: at your option)? any later version| or later| or newer)"

#: Between name and version in the notices that the GNU licenses ask for.
_NOTICE = "(?: as published by the free software foundation(?: inc)?)(?: either)? (?:version|v|ver)"
_IN_NOTICES = ("gpl", "lgpl", "agpl")

#: Families with versions: name -> (label, keyword, pattern of the name, versions).
_VERSIONED = {
    "gnu general public license": ("gpl", "general public license", "(?:gnu )?general public license", ("1 0", "2 0", "3 0", "1", "2", "3")),
    "gpl": ("gpl", "gpl", "(?:gnu )?gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    "gnu lesser general public license": ("lgpl", "lesser general public license", "(?:gnu )?lesser general public license", ("2 0", "2 1", "3 0", "2", "3")),
    "lgpl": ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    "gnu library general public license": ("lgpl", "library general public license", "(?:gnu )?library general public license", ("2 0", "2")),
    "gnu affero general public license": ("agpl", "affero general public license", "(?:gnu )?affero general public license", ("1 0", "3 0", "1", "3")),
    "agpl": ("agpl", "agpl", "(?:gnu )?agpl", ("1 0", "3 0", "1", "3")),
    "gnu free documentation license": ("gfdl", "free documentation license", "(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
    "apache license": ("apache", "apache license", "apache license", ("1 0", "1 1", "2 0", "2")),
    "apache software license": ("apache", "apache software license", "apache software license", ("1 0", "1 1", "2 0")),
    "mozilla public license": ("mpl", "mozilla public license", "mozilla public license", ("1 0", "1 1", "2 0")),
    "mpl": ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    "eclipse public license": ("epl", "eclipse public license", "eclipse public license", ("1 0", "2 0")),
    "common development and distribution license": ("cddl", "distribution license", "common development and distribution license", ("1 0", "1 1")),
    "common public license": ("cpl", "common public license", "common public license", ("1 0",)),
    "european union public licence": ("eupl", "european union public", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    "artistic license": ("artistic", "artistic license", "artistic license", ("1 0", "2 0")),
    "academic free license": ("afl", "academic free license", "academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "open software license": ("osl", "open software license", "open software license", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    "boost software license": ("bsl", "boost software license", "boost software license", ("1 0",)),
    "sil open font license": ("ofl", "open font license", "(?:sil )?open font license", ("1 0", "1 1")),
    "microsoft public license": ("ms-pl", "microsoft public license", "microsoft public license", ()),
    "microsoft reciprocal license": ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license", ()),
    "zope public license": ("zpl", "zope public license", "zope public license", ("1 1", "2 0", "2 1")),
    "python software foundation license": ("psf", "python software foundation", "python software foundation license", ("2",)),
    "php license": ("php", "php license", "php license", ("3 0", "3 01")),
    "server side public license": ("sspl", "server side public license", "server side public license", ("1",)),
    "creative commons zero": ("cc0", "creative commons zero", "creative commons zero", ("1 0",)),
    "cc0": ("cc0", "cc0", "cc0", ("1 0",)),
    "universal permissive license": ("upl", "universal permissive license", "universal permissive license", ("1 0",)),
}

#: Licenses without versions: label -> (keyword, pattern).
_PLAIN = {
    "mit": ("mit license", "(?:the )?mit license"), "mit-terms": ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"), "mit-expat": ("expat license", "expat license"),
    "mit-x11": ("x11 license", "(?:mit )?x11 license"), "isc": ("isc license", "isc license"), "isc-terms": ("permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    "bsd": ("bsd license", "bsd license"), "bsd-style": ("bsd style", "bsd style license"), "bsd-2": ("bsd 2 clause", "bsd 2 clause(?: license)?"), "bsd-3": ("bsd 3 clause", "bsd 3 clause(?: license)?"), "bsd-4": ("bsd 4 clause", "bsd 4 clause(?: license)?"), "bsd-0": ("0bsd", "0bsd"),
    "bsd-simplified": ("simplified bsd", "simplified bsd license"), "bsd-new": ("new bsd", "new bsd license"), "bsd-modified": ("modified bsd", "modified bsd license"), "bsd-terms": ("redistribution and use in source", "redistribution and use in source and binary forms with or without modification"), "bsd-endorse": ("neither the name of", "neither the name of .{1,80}? may be used to endorse"),
    "zlib": ("zlib license", "zlib license"), "libpng": ("libpng license", "libpng license"), "unlicense": ("unlicense", "unlicense"), "wtfpl": ("wtfpl", "wtfpl"), "beerware": ("beerware", "beerware(?: license)?"), "public-domain": ("public domain", "(?:in|into|to) the public domain"),
    "postgresql": ("postgresql license", "postgresql license"), "openssl": ("openssl license", "openssl license"), "ncsa": ("ncsa open source license", "ncsa open source license"), "w3c": ("w3c software", "w3c software (?:notice and )?license"), "curl": ("curl license", "curl license"), "vim": ("vim license", "vim license"), "ruby": ("ruby license", "ruby license"), "json": ("json license", "json license"),
    "all-rights-reserved": ("all rights reserved", "all rights reserved"), "proprietary": ("proprietary license", "proprietary license"), "warranty-disclaimer": ("without warranty of any kind", "without warranty of any kind"), "as-is": ("provided as is", "provided as is"), "cecill": ("cecill", "cecill(?: [bc])?"), "odbl": ("open database license", "open database license"), "etalab": ("etalab", "etalab"),
}

#: Parts of Creative Commons licenses, in the order in which they are written.
_CC_PARTS = {"by": "by", "nc": "nc", "nd": "nd", "sa": "sa"}
_CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s", "sa": "share ?alike"}
#: Identifiers after "spdx license identifier".
_SPDX = ("mit", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 2 0", "epl 2 0", "cc0 1 0", "cc by 4 0", "unlicense", "zlib", "bsl 1 0")

RULES_SCHEMA = T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("base", T.BooleanType())])


def signature_rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """All rules in order (rule, label, keyword, pattern, priority, confidence, base); patterns match runs of whole words."""
    rules = [(label, phrase, phrase, 10, 0.8, True) for phrase, label in BASE.items()]
    for name, (label, keyword, pattern, versions) in _VERSIONED.items():
        rules.append((label, keyword, pattern, 10, 0.6 if " " not in name else 0.8, False))
        rules.append((f"{label}-or-later", keyword, f"{pattern}.{{0,40}}?{_OR_LATER}", 25, 0.95, False))
        for version in versions:
            rules.append((f"{label}-{version.replace(' ', '.')}", keyword, f"{pattern}{_VERSION} v?{version}", 30 + len(version), 0.98, False))
    rules += [(label, keyword, pattern, 20, 0.9, False) for label, (keyword, pattern) in _PLAIN.items()]
    for kind in _CC_KINDS:
        words = " ".join(_CC_WORDS[p] for p in kind.split())
        label = f"cc-{kind.replace(' ', '-')}"
        rules.append((label, f"cc {kind}", f"cc {kind}", 20 + len(kind), 0.9, False))
        rules.append((label, "creative commons", f"creative commons {words}", 20 + len(kind), 0.9, False))
        for version in _CC_VERSIONS:
            rules.append((f"{label}-{version.replace(' ', '.')}", f"cc {kind}", f"cc {kind} {version}", 40 + len(kind), 0.98, False))
            rules.append((f"{label}-{version.replace(' ', '.')}", "creative commons", f"creative commons {words}{_VERSION}(?: license)? {version}", 40 + len(kind), 0.98, False))
    rules += [(f"spdx-{i.replace(' ', '-')}", "spdx license identifier", f"spdx license identifier {i}", 50 + len(i), 1.0, False) for i in _SPDX]
    for label, keyword, pattern, versions in _VERSIONED.values():
        if label in _IN_NOTICES:
            notice = f"{pattern}{_NOTICE}"
            rules.append((f"{label}-or-later", keyword, f"{notice} v?[0-9](?: [0-9])?(?: of the license)?{_OR_LATER}", 25, 0.95, False))
            rules += [(f"{label}-{v.replace(' ', '.')}", keyword, f"{notice} v?{v}(?: of the license)?", 30 + len(v), 0.98, False) for v in versions]
    return [(n, *rule) for n, rule in enumerate(rules)]


def anchors(keywords: list[str]) -> list[str]:
    """A few words or keywords of which every keyword holds one, so that most texts are done after a few searches."""
    holds = lambda anchor, keyword: f" {anchor} " in f" {keyword} "
    candidates = sorted({w for k in keywords for w in k.split() if len(w) >= 3} | set(keywords))
    left, chosen = set(keywords), []
    while left:
        best = max(candidates, key=lambda c: (sum(holds(c, k) for k in left), len(c)))
        chosen.append(best)
        left = {k for k in left if not holds(best, k)}
    return chosen


def words_text(text: Column) -> Column:
    """The words of a text, A-Z lowered, each between single spaces; two spaces for none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parted = F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(parted), F.lit(" "))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def rule_table(spark: SparkSession) -> DataFrame:
    """The signature rules as rows, of a fixed number."""
    return spark.createDataFrame(signature_rules(), RULES_SCHEMA)


def detections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules find: (row_no, doc_id, rule, label, priority, confidence, base, first_word, last_word, kept), words from 0.

    kept is false for a detection inside another of at least its priority (of equal spans the higher priority, then the
    earlier rule, stays).
    """
    return _found(_worded(docs, id_col, text_col))


def _worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_no, doc_id, n_words, words), stored; words only where an anchor occurs, which few texts have."""
    plain = document_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("row_no", row_id())
    # exploded so that the words are made once for a row and not in each of the conditions on them
    worded = plain.select("row_no", "doc_id", F.explode(F.array(words_text(F.col("text")))).alias("words"))
    n_words = F.when(F.length("words") <= 2, F.lit(0).cast("long")).otherwise(spaces(F.col("words")) - 1)
    keywords = sorted({r[2] for r in signature_rules()})
    gate = functools.reduce(operator.or_, [F.contains(F.col("words"), F.lit(f" {a} ")) for a in anchors(keywords)])
    return stored(worded.select("row_no", "doc_id", n_words.alias("n_words"), F.when(gate, F.col("words")).alias("words")))


def _found(worded: DataFrame) -> DataFrame:
    spark = worded.sparkSession
    rules = signature_rules()
    keywords = sorted({r[2] for r in rules})
    padded = F.col("words")
    present = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))
    gated = worded.where("words is not null").withColumn("keyword", F.explode(present)).drop("n_words")
    tried = gated.join(F.broadcast(rule_table(spark)), "keyword")  # a fixed few hundred rules
    pattern = F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )"))
    # what stands before, between and after the matches, counted in words, gives each match its place
    tried = tried.withColumn("hit", F.expr("regexp_extract_all(words, concat('(?<= )(?:', pattern, ')(?= )'), 0)")).where(F.size("hit") > 0).withColumn("gap", F.split("words", pattern))
    tried = tried.select("row_no", "doc_id", "rule", "label", "priority", "confidence", "base", F.posexplode(F.arrays_zip(F.transform("gap", spaces).alias("g"), F.transform("hit", spaces).alias("h"))).alias("n", "at"))
    so_far = Window.partitionBy("row_no", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("at.g") + F.col("at.h")).over(so_far), F.lit(0)) + F.col("at.g") - 1
    placed = tried.withColumn("first_word", first).withColumn("length", F.col("at.h")).where(F.col("length").isNotNull()).withColumn("last_word", F.col("first_word") + F.col("length")).drop("at", "n", "length")
    return _suppressed(placed)


def _suppressed(placed: DataFrame) -> DataFrame:
    """Marks detections inside another of at least their priority.

    In the order (first word, longest, priority, rule) whatever contains a detection stands before it, so a running maximum of
    the last words for each priority from the detection's up tells; priorities are a fixed few.
    """
    levels = sorted({r[4] for r in signature_rules()})
    before = Window.partitionBy("row_no").orderBy("first_word", F.desc("last_word"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.coalesce(F.max(F.when(F.col("priority") >= level, F.col("last_word"))).over(before), F.lit(-1)).alias(f"end_{level}") for level in levels]
    inside = F.coalesce(*[F.when(F.col("priority") == level, F.col(f"end_{level}") >= F.col("last_word")) for level in levels])
    return placed.select("*", *ends).withColumn("kept", F.col("base") | ~inside).drop(*[f"end_{level}" for level in levels])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest word at which
    one starts (null without any); labels are distinct, sorted and joined by commas, "" for none; score is the highest confidence of
    a kept detection, 0 without any. Null and empty texts have no words. Repeated rows are scanned each. An empty table gives an empty
    result.
    """
    worded = _worded(docs, id_col, text_col)
    found = _found(worded)
    base = F.col("base")
    by_doc = found.groupBy("row_no").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"), F.max(F.when(F.col("kept"), F.col("confidence"))).alias("score"),
    )
    return worded.join(by_doc, "row_no", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
