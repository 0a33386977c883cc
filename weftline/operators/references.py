"""Discovering, resolving and rewriting references: one row for each reference of each text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import discovery, gltf, markup, media, paths, urls
from ..sources.tables import materialized

#: Comments of scripts and style sheets that name their source maps.
SOURCE_MAP_COMMENT = r"(?i)(?://[#@]\s*sourceMappingURL=[^\r\n]*|/\*[#@]\s*sourceMappingURL=[^*]*\*/)"

def discover(texts: DataFrame, syntax: str | None = None) -> DataFrame:
    """References of texts (owner, base_url, text[, syntax, where each has its own]) in order; a text that breaks off has only the row of its fault (n = -1)."""
    if syntax:
        texts = texts.withColumn("syntax", F.lit(syntax))
    return texts.select(*discovery.TEXT).mapInArrow(discovery.in_arrow, discovery.ROW)


def _discovered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same on frames, outside of Spark."""
    texts = (text for batch in batches for text in batch[list(discovery.TEXT)].itertuples(index=False))
    return (pd.DataFrame(part, columns=discovery.NAMES) for part in discovery.parts(texts))


def fetchable(found: DataFrame) -> DataFrame:
    """References that a capture would fetch: network ones that aren't mere navigation."""
    return found.where((F.col("n") >= 0) & (F.col("kind") == "network") & (F.col("role") != "navigation"))


def faults(found: DataFrame, phase: str = "resource-discovery") -> DataFrame:
    """Diagnostics of the texts that broke off: (owner, code, severity, phase, message)."""
    return found.where("n = -1").select("owner", F.concat(F.lit("resource-parser-"), "syntax", F.lit("-failed")).alias("code"), F.lit("warning").alias("severity"), F.lit(phase).alias("phase"), F.col("fault").alias("message"))


def resolve(found: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds disposition, reason and replacement; resources: (url, local_path[, position]), with redirects and aliases followed already.

    Of resources of one URL the last by position counts, without positions the greatest path.
    """
    last = F.max_by("local_path", "position") if "position" in resources.columns else F.max("local_path")
    known = resources.groupBy(F.col("url").alias("normalized_url")).agg(last.alias("local_path"))
    r = found.join(known, "normalized_url", "left")
    fragment = F.regexp_extract("resolved_url", "(#.*)$", 1)
    local = F.concat(F.when(F.startswith("local_path", F.lit("/")), "").otherwise("/"), "local_path", fragment)
    role = F.col("role")
    blocked = F.when(role.isin("stylesheet", "css-import"), markup.blocked_value("stylesheet")).when(role.isin("script", "module"), markup.blocked_value("script")).when(role == "frame", "about:blank").otherwise("data:,")
    rules = [
        (F.col("kind") == "invalid", "unresolved", F.lit("invalid-url"), F.col("raw_value")),
        (F.col("kind") == "", "unresolved", F.lit("empty-url"), F.col("raw_value")),
        (F.col("kind") != "network", "preserved", F.col("kind"), F.col("raw_value")),
        (F.col("local_path").isNotNull(), "localized", F.lit("captured"), local),
        (F.col("policy") == "preserve-navigation", "preserved", F.lit("navigation"), F.col("raw_value")),
        (F.col("policy") == "localize-if-captured", "preserved", F.lit("uncaptured-runtime-resource"), F.col("raw_value")),
        (F.col("policy") == "block-unresolved-executable", "blocked", F.lit("unresolved-executable"), blocked),
        (F.lit(True), "blocked", F.lit("unresolved-subresource"), blocked),
    ]
    pick = lambda i: F.coalesce(*[F.when(rule[0], F.lit(rule[i]) if isinstance(rule[i], str) else rule[i]) for rule in rules])
    return r.where("n >= 0").withColumn("disposition", pick(1)).withColumn("reason", pick(2)).withColumn("replacement", pick(3)).drop("local_path")


def rewrite(texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(owner, text, replaced) with replacements in place, last first so that offsets hold; a text without any stays as it is."""
    changes = resolved.where("replacement <> raw_value").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("start", "end", "quote", "replacement")), asc=False).alias("changes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for owner, text, own in batch[["owner", "text", "changes"]].itertuples(index=False):
                own = [] if own is None else list(own)
                for c in own:
                    new = c["replacement"]
                    if c["quote"]:
                        new = new.replace("\\", "\\\\").replace(c["quote"], "\\" + c["quote"])
                    text = text[: c["start"]] + new + text[c["end"] :]
                out.append((owner, text, len(own)))
            yield pd.DataFrame(out, columns=["owner", "text", "replaced"])

    return texts.join(changes, "owner", "left").select("owner", "text", "changes").mapInPandas(run, "owner string, text string, replaced int")


def diagnostics(resolved: DataFrame) -> DataFrame:
    """Blocked and unresolved references: errors where code would have run."""
    severity = F.when(F.col("role").isin(*sorted(markup.EXECUTABLE_ROLES)), "error").otherwise("warning")
    return resolved.where(F.col("disposition").isin("blocked", "unresolved")).select("owner", F.col("reason").alias("code"), severity.alias("severity"), F.concat_ws(" ", "syntax", "raw_value", F.lit("was"), "disposition").alias("message"))


def rewritten_kind(mime: Column, url: Column) -> Column:
    """How a text is rewritten, by its type and the ending of its URL; null for texts that stay."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(F.startswith(kind, F.lit("text/html")), "html").when(F.startswith(kind, F.lit("text/css")), "css").when(F.startswith(kind, F.lit("image/svg+xml")), "svg")
        .when(media.is_gltf_url(url) | F.contains(kind, F.lit("model/gltf+json")), "gltf")
        .when(F.rlike(kind, F.lit("(?:java|ecma)script")) | F.rlike(F.lower(url), F.lit(r"\.(?:js|mjs)(?:$|[?#])")), "javascript")
    )


def rewrite_resources(resources: DataFrame, known: DataFrame, bootstrap: str = "") -> tuple[DataFrame, DataFrame]:
    """Every resource (owner, url, mime_type, text, route_page) with its references led to ``known`` (url, local_path[, position]), and what went wrong.

    Returns (owner, kind, text, artifact_hash, replaced) and diagnostics (owner, code, severity, phase, message). A text that breaks off stays as it is and
    is reported; others aren't touched by it. Comments that name source maps go from scripts and style sheets. Route pages get the bootstrap.
    Texts of other kinds stay as they are, without an artifact.
    """
    r = resources.withColumn("kind", rewritten_kind(F.col("mime_type"), F.col("url")))
    marked = r.where(F.col("kind").isin("html", "css", "svg", "javascript")).select("owner", F.col("url").alias("base_url"), "text", F.col("kind").alias("syntax"))
    found = materialized(discover(marked))
    resolved = resolve(found, known)
    changed = rewrite(marked, resolved).unionByName(rewritten_gltf(r.where("kind = 'gltf'").select("owner", F.col("url").alias("base_url"), "text"), known))
    done = r.select("owner", "kind", "route_page", F.col("text").alias("before")).join(changed, "owner", "left")
    done = done.join(found.where("n = -1").select("owner", F.lit(True).alias("broken")), "owner", "left")
    text = F.coalesce("text", "before")
    plain = F.when(F.col("kind").isin("css", "javascript") & F.col("broken").isNull(), F.regexp_replace(text, SOURCE_MAP_COMMENT, "")).when(F.col("kind") == "html", without_foreign(text)).otherwise(text)
    started = F.when(F.col("route_page") & (F.col("kind") == "html"), with_bootstrap(plain, bootstrap)).otherwise(plain)
    out = done.select("owner", "kind", started.alias("text"), F.when(F.col("kind").isNotNull() & (F.col("broken").isNull() | (F.col("kind") == "html")), paths.content_hash(plain)).alias("artifact_hash"), F.coalesce("replaced", F.lit(0)).alias("replaced"))
    wrong = diagnostics(resolved).withColumn("phase", F.lit("resource-rewrite")).unionByName(
        faults(found, "resource-rewrite").withColumn("code", F.when(F.col("code") == "resource-parser-html-failed", "resource-parser-html-rewrite-failed").otherwise("resource-parser-rewrite-failed"))
    )
    return out, wrong


def rewritten_gltf(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(owner, text, replaced): glTF documents (owner, base_url, text) whose files are led to known ones; what is no JSON stays as it is."""
    named = F.posexplode(gltf.uris(F.col("text"))).alias("n", "raw")
    files = texts.select("owner", "base_url", named).where(~F.rlike("raw", F.lit("(?i)^(?:data:|blob:|javascript:|mailto:|tel:|#)")))
    files = files.withColumn("url", urls.normalized(urls.resolved(F.col("raw"), F.col("base_url"))))
    last = F.max_by("local_path", "position") if "position" in known.columns else F.max("local_path")
    local = files.join(known.groupBy("url").agg(last.alias("local_path")), "url").groupBy("owner").agg(F.collect_set(F.struct("raw", F.concat(F.lit("/"), "local_path").alias("to"))).alias("local"))
    return texts.join(local, "owner", "left").select("owner", gltf.with_uris(F.col("text"), F.col("local")).alias("text"), F.coalesce(F.size("local"), F.lit(0)).alias("replaced"))


@F.pandas_udf(T.StringType())
def without_foreign(texts: pd.Series) -> pd.Series:
    """Pages that reach out to nothing (see markup.standalone_page)."""
    return pd.Series([None if t is None else markup.standalone_page(t) for t in texts], dtype=object)


def with_bootstrap(text: Column, bootstrap: Column | str) -> Column:
    """bootstrap after the first head tag, or in front of a page without one."""
    bootstrap = F.lit(bootstrap) if isinstance(bootstrap, str) else bootstrap
    found = F.regexp_extract(text, r"(?i)<head(?:\s[^>]*)?>", 0)
    at = F.instr(text, found)
    placed = F.concat(F.substring(text, F.lit(1), at + F.length(found) - 1), bootstrap, F.substring(text, at + F.length(found), F.length(text)))
    return F.when(found == "", F.concat(bootstrap, text)).otherwise(placed)


def with_marker(text: Column, marker: Column) -> Column:
    """A page that tells a validator which route it is."""
    quoted = F.regexp_replace(F.to_json(F.array(marker)), r"^\[|\]$", "")
    return with_bootstrap(text, F.concat(F.lit("<script>document.documentElement.dataset.validationMarker="), quoted, F.lit(";</script>")))
