"""What a report says about a capture: links back to evidence, parity, merged diagnostics, stability of repeated runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gltf, privacy, urls, whatwg


def linked_edges(edges: DataFrame, refetched: DataFrame) -> DataFrame:
    """Dependency edges without a target get the first refetched response (id, normalized_url, sequence) of their URL."""
    first = refetched.groupBy("normalized_url").agg(F.min_by("id", "sequence").alias("found"))
    joined = edges.join(first, "normalized_url", "left")
    new = F.col("target_evidence_id").isNull() & F.col("found").isNotNull()
    return joined.withColumn("disposition", F.when(new, "refetched").otherwise(F.col("disposition"))).withColumn("target_evidence_id", F.coalesce("target_evidence_id", "found")).drop("found")


def recovered_routes(routes: DataFrame, refetched: DataFrame) -> DataFrame:
    """Failed routes whose page (url, final_url, document_id) was fetched after all count as captured, unrendered."""
    page = refetched.groupBy(F.col("url").alias("route_url")).agg(F.min(F.struct("document_id", "final_url")).alias("page"))
    joined = routes.join(page, "route_url", "left")
    now = (F.col("state") == "failed") & F.col("page").isNotNull()
    change = lambda name, value: F.when(now, value).otherwise(F.col(name)).alias(name)
    kept = [F.col(c) for c in routes.columns if c not in ("state", "decision_reason", "final_url", "document_id", "fidelity")]
    return joined.select(*kept, change("state", F.lit("captured")), change("decision_reason", F.lit("rendered-navigation-failed-fetch-fallback")), change("final_url", F.coalesce("page.final_url", "route_url")), change("document_id", F.col("page.document_id")), change("fidelity", F.lit("unrendered-refetch")))


def body_mismatches(projected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Projected bodies (url, mime_type, content_hash, preserve_url) that no catalog resource (url, aliases, ..., route_page) answers."""
    names = catalog.where("not route_page").withColumn("name", F.explode(F.array_union(F.array("url"), F.coalesce("aliases", F.array().cast("array<string>")))))
    held = names.select(F.col("name").alias("c_url"), F.col("mime_type").alias("c_type"), F.col("content_hash").alias("c_hash"), F.col("preserve_url").alias("c_keep"))
    same = (F.col("url") == F.col("c_url")) & F.col("mime_type").eqNullSafe(F.col("c_type")) & (F.col("content_hash") == F.col("c_hash")) & (~F.col("preserve_url") | F.col("c_keep"))
    return projected.join(held, same, "left_anti")


def snapshot_mismatches(projected: DataFrame, replayed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Positions at which two lists of snapshots (position, fields) differ, or that only one of them has."""
    a, b = projected.select("position", F.struct(*fields).alias("left")), replayed.select("position", F.struct(*fields).alias("right"))
    return a.join(b, "position", "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select("position")


def entry_html(captures: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_url, html, method): quick captures without live state take the document the network gave, if it has an html tag."""
    first = bodies.where(F.startswith(F.lower("mime_type"), F.lit("text/html"))).groupBy(urls.normalized(F.col("url")).alias("key")).agg(F.min_by("text", "position").alias("text"))
    c = captures.withColumn("key", urls.normalized(F.col("page_url"))).join(first, "key", "left")
    network = (F.col("capture_mode") == "quick") & ~F.col("needs_live_dom") & F.coalesce(F.rlike("text", F.lit(r"(?i)<html\b")), F.lit(False))
    return c.select("page_url", F.when(network, F.col("text")).otherwise(F.col("captured_html")).alias("html"), F.when(network, "network-document-v1").otherwise("live-dom-state-v1").alias("method"))


def restored_hydration(html: Column, source: Column) -> Column:
    """html with the hydration scripts of the source document before its first module script, else before its end; unless it has them."""
    marks = r"\$_TSR|tsr-stream-barrier|self\.\$R"
    scripts = F.filter(F.regexp_extract_all(source, F.lit(r"(?is)<script\b[^>]*>.*?</script>"), 0), lambda s: F.rlike(s, F.lit(marks)))
    added = F.array_join(scripts, "")
    module = F.regexp_extract(html, r"""(?i)<script\b(?=[^>]*\btype=["']module["'])[^>]*>""", 0)
    at = F.when(module != "", F.instr(html, module)).otherwise(F.instr(F.lower(html), F.lit("</body>")))
    placed = F.concat(F.substring(html, F.lit(1), at - 1), added, F.substring(html, at, F.length(html)))
    needed = (F.size(scripts) > 0) & ~F.rlike(html, F.lit(r"\$_TSR|tsr-stream-barrier")) & (at > 0)
    return F.when(F.coalesce(needed, F.lit(False)), placed).otherwise(html)


def merged_diagnostics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code", "reason").agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("count"))


def distinct_diagnostics(*lists: DataFrame) -> DataFrame:
    """All lists together, each diagnostic once."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    return every.distinct()


def bounded_items(items: DataFrame, most: int = 100) -> DataFrame:
    """Report lists: of each type (report, type, position, item) the first most different items, and whether there were more."""
    first = items.groupBy("report", "type", "item").agg(F.min("position").alias("position"))
    n = F.row_number().over(Window.partitionBy("report", "type").orderBy("position"))
    total = F.count(F.lit(1)).over(Window.partitionBy("report", "type"))
    return first.withColumn("n", n).withColumn("truncated", total > most).where(F.col("n") <= most).drop("n")


def stability(runs: DataFrame) -> DataFrame:
    """Of repeated runs (fixture, run, signature, duration_ms, size) whether all equal the first, how many don't, and the extremes."""
    first = F.first("signature").over(Window.partitionBy("fixture").orderBy("run"))
    marked = runs.withColumn("differs", ~F.col("signature").eqNullSafe(first))
    summed = marked.groupBy("fixture").agg(F.count(F.lit(1)).alias("runs"), F.count_if("differs").alias("divergent"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    return summed.withColumn("stable", F.col("divergent") == 0)


def normal_diagnostic(text: Column) -> Column:
    """Without what differs from run to run: origins and places in files."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://[^/\s)'\"\]]+", "<origin>"), r":\d+:\d+", ":<line>:<column>")


def persisted(bodies: DataFrame) -> DataFrame:
    return bodies.agg(F.count(F.lit(1)).alias("bodies"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("peak"))


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last of each key's updates by sequence, field by field: a null leaves a field as it was."""
    order = Window.partitionBy(key).orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in updates.columns if c not in (key, "sequence")]
    return updates.select(key, *[F.last(c, ignorenulls=True).over(order).alias(c) for c in fields]).distinct()


def form_findings(snapshots: DataFrame) -> DataFrame:
    """Form snapshots (id, json) sanitized, with one finding for the fields that capture redacted itself."""
    s = snapshots.withColumn("clean", privacy.sanitized_metadata(F.col("json")))
    n = F.coalesce(F.get_json_object("clean.json", "$.redactedFields").cast("int"), F.lit(0))
    return s.select("id", F.col("clean.json").alias("json"), (F.size("clean.findings") + (n > 0).cast("int")).alias("found"), F.when(n > 0, F.concat(F.lit("<redacted:"), n, F.lit(" fields>"))).alias("masked"))


# URLs that documents of other kinds name --------------------------------------------------------------------------


def source_map_urls(texts: DataFrame) -> DataFrame:
    """(owner, url): source maps that comments of scripts and style sheets (owner, base_url, text) name, of the same origin."""
    named = texts.select("owner", "base_url", F.explode(F.regexp_extract_all("text", F.lit(r"[#@]\s*sourceMappingURL=([^\s'\"*]+)"), 1)).alias("raw"))
    found = named.select("owner", "base_url", urls.normalized(urls.resolved(F.col("raw"), F.col("base_url"))).alias("url"))
    return found.where(urls.is_http(F.col("url")) & (urls.origin(F.col("url")) == urls.origin(F.col("base_url")))).select("owner", "url").distinct()


def import_map_urls(texts: DataFrame) -> DataFrame:
    """(owner, url): where the import maps of pages lead."""
    maps = texts.select("owner", "base_url", F.explode(F.regexp_extract_all("text", F.lit(r"""(?is)<script\b[^>]*\btype=["']importmap["'][^>]*>(.*?)</script>"""), 1)).alias("json"))
    imports = F.from_json(F.get_json_object("json", "$.imports"), "map<string,string>")
    raw = maps.select("owner", "base_url", F.explode(F.map_values(imports)).alias("raw")).where(F.rlike("raw", F.lit(r"(?i)^(\.\.?/|/|https?:)")))
    return _absolute(raw)


def _absolute(raw: DataFrame) -> DataFrame:
    """(owner, url) of references (owner, base_url, raw), each once; a step that gives rows, as a filter on a function's result would have it called twice."""

    def one(value: str, base: str) -> str | None:
        try:
            url = whatwg.normalized(value, base)
        except ValueError:
            return None
        return url if url.startswith(("http:", "https:")) else None

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"owner": batch["owner"], "url": pd.Series([one(v, b) for v, b in zip(batch["raw"], batch["base_url"], strict=True)], index=batch.index, dtype=object)}).dropna(subset="url")

    kind = raw.schema["owner"].dataType.simpleString()
    return raw.select("owner", "base_url", "raw").mapInPandas(joined, f"owner {kind}, url string").distinct()


def gltf_urls(texts: DataFrame) -> DataFrame:
    """(owner, url): files that glTF documents name at any depth; data URLs and texts that aren't JSON name none."""
    raw = texts.select("owner", "base_url", F.explode(gltf.uris(F.col("text"))).alias("raw"))
    return _absolute(raw.where(~F.startswith(F.lower("raw"), F.lit("data:"))))


def escaped_html(text: Column) -> Column:
    """Text as it may stand in a page."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return F.coalesce(text, F.lit(""))


def runtime_json(record: Column) -> Column:
    """A record as JSON that may stand in a script and in a template of one."""
    return F.replace(F.replace(F.to_json(record), F.lit("<"), F.lit("\\u003c")), F.lit("`"), F.lit("\\u0060"))
