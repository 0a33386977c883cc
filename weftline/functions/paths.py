"""Hashes and archive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import media, urls

EMPTY_HASH = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def content_hash(body: Column) -> Column:
    """Named SHA-256 of bytes or of text in UTF-8; null stays null, so that no body and an empty body differ."""
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def _hash(text: Column) -> Column:
    """32 bits of h = 33 h xor unit from 5381; equal to the UTF-16 form but for characters beyond U+FFFF."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseAND(F.lit(4294967295)).bitwiseXOR(c))


def short_hash(text: Column) -> Column:
    """The hash in base 36."""
    return F.lower(F.conv(_hash(text).cast("string"), 10, 36))


def fingerprint(html: Column) -> Column:
    """By which states of a page are told apart: the hash of its first 50,000 characters, in decimal figures."""
    return _hash(F.substring(F.coalesce(html, F.lit("")), 1, 50_000)).cast("string")


def safe_segment(segment: Column) -> Column:
    """Percent-decoded if it can be, with what file systems reject as underscores; never empty."""
    decoded = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    safe = F.regexp_replace(decoded, r'[<>:"\\|?*\x00-\x1f]', "_")
    return F.when(safe == "", "_").otherwise(safe)


def archive_path(url: Column, mime: Column) -> Column:
    """assets/host/folders/file, with an extension by type and the query's short hash before it."""
    segments = F.transform(F.filter(F.split(urls.pathname(url), "/"), lambda s: s != ""), safe_segment)
    name = F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("index"))
    named = F.when(~F.rlike(F.lower(name), F.lit(r"\.[a-z0-9]{1,10}$")), F.concat(name, media.extension(mime))).otherwise(name)
    mark = F.concat(F.lit("."), short_hash(urls.search(url)))
    dotted = F.rlike(named, F.lit(r"^.+\.[^.]*$"))
    marked = F.when(dotted, F.concat(F.regexp_extract(named, r"^(.+)\.[^.]*$", 1), mark, F.regexp_extract(named, r"(\.[^.]*)$", 1))).otherwise(F.concat(named, mark))
    full = F.when(urls.search(url) != "", marked).otherwise(named)
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.concat_ws("/", F.concat(F.array(F.lit("assets"), safe_segment(urls.host(url))), folders, F.array(full)))


def snapshot_path(exchange_id: Column, sequence: Column, index: Column, mime: Column) -> Column:
    kind = media.extension(mime)
    key = F.concat_ws("\n", F.coalesce(exchange_id, F.lit("exchange")), F.when(F.coalesce(sequence, F.lit(0)) != 0, sequence).otherwise(index).cast("string"), index.cast("string"))
    return F.concat(F.lit("api-snapshots/"), short_hash(key), F.when(kind == "", ".bin").otherwise(kind))


def with_suffix(path: Column, n: Column) -> Column:
    """The n-th taker of a path: the first as it is, then -2, -3 before the extension."""
    mark = F.concat(F.lit("-"), n.cast("string"))
    dotted = F.rlike(path, F.lit(r"^.+\.[^.]*$"))
    marked = F.when(dotted, F.concat(F.regexp_extract(path, r"^(.+)\.[^.]*$", 1), mark, F.regexp_extract(path, r"(\.[^.]*)$", 1))).otherwise(F.concat(path, mark))
    return F.when(n > 1, marked).otherwise(path)


def without_suffix(path: Column) -> tuple[Column, Column]:
    """The path of which this one is a numbered name, and the number (2 or more); nulls if it is of none."""
    dotted = F.rlike(path, F.lit(r"^.+\.[^.]*$"))
    front = F.when(dotted, F.regexp_extract(path, r"^(.+)\.[^.]*$", 1)).otherwise(path)
    ending = F.when(dotted, F.regexp_extract(path, r"(\.[^.]*)$", 1)).otherwise("")
    number = F.regexp_extract(front, "^.+-([1-9][0-9]{0,17})$", 1)
    counts = (number != "") & (number != "1")
    return F.when(counts, F.concat(F.regexp_extract(front, "^(.+)-[0-9]+$", 1), ending)), F.when(counts, number).cast("long")


def archive_name(path: Column) -> Column:
    """Slashes forward, none in front, percent-decoded if it can be."""
    plain = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "^/+", "")
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def is_safe_path(path: Column) -> Column:
    """Whether a path stays below its folder."""
    return ~F.exists(F.split(archive_name(path), "/"), lambda s: s == "..")


def dedup_key(content: Column, mime: Column, url: Column, route_page: Column) -> Column:
    """Hash, type and, of texts, the folder: texts of other folders resolve their references differently. Empty for route pages."""
    scope = F.when(media.is_optimizer_text(mime), urls.base_scope(url)).otherwise("binary")
    return F.when(route_page | content.isNull(), "").otherwise(F.concat_ws("\n", content, media.normalized_type(mime), scope))
