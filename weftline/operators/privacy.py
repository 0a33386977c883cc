"""Privacy of whole capture graphs and of what goes into an archive."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, privacy
from ..sources.tables import materialized

URL_FIELDS = ("source_url", "original_url", "normalized_url", "route_url")


def sanitized_requests(requests: DataFrame) -> DataFrame:
    """Requests (headers map, request_body, request_body_hash, content_type and URL columns) without secrets; a body that held any loses its hash."""
    r = requests
    for name in URL_FIELDS:
        if name in r.columns:
            r = r.withColumn(name, privacy.sanitized_url(F.col(name))["url"])
    if "headers" in r.columns:
        r = r.withColumn("_headers", privacy.sanitized_headers(F.col("headers"))).withColumn("headers", F.col("_headers.headers"))
    cleaned = privacy.sanitized_body(F.col("request_body"), F.col("content_type"))
    r = r.withColumn("_clean", cleaned)
    held = F.size("_clean.findings") > 0
    return r.withColumn("request_body", F.col("_clean.body")).withColumn("request_body_hash", F.when(held, F.lit(None).cast("string")).otherwise(F.col("request_body_hash"))).withColumn("redactions", F.when(F.col("request_body").isNull(), 0).otherwise(F.size("_clean.findings"))).drop("_clean", "_headers")


def sanitized_graph(families: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Record families without secrets, and a row for each family: (family, records, redactions).

    Of requests and responses headers (a map) are cleaned as headers, of requests bodies by their type, and a body that held a secret loses its hash; then all
    records are cleaned as nested metadata: URLs, members with telling names, and what detectors find in texts.
    """
    clean, counts = {}, []
    for name, rows in families.items():
        kinds = rows.schema
        r = rows.withColumn("_found", F.lit(0))
        for field in [f for f in URL_FIELDS if f in rows.columns]:
            r = r.withColumn("_part", privacy.sanitized_url(F.col(field))).withColumn(field, F.col("_part.url")).withColumn("_found", F.col("_found") + F.coalesce(F.size("_part.findings"), F.lit(0))).drop("_part")
        if "headers" in rows.columns:
            r = r.withColumn("_part", privacy.sanitized_headers(F.col("headers"))).withColumn("headers", F.col("_part.headers")).withColumn("_found", F.col("_found") + F.size("_part.findings")).drop("_part")
        if "request_body" in rows.columns:
            kind = F.col("content_type") if "content_type" in rows.columns else media.header(F.col("headers"), "content-type")
            r = r.withColumn("_part", privacy.sanitized_body(F.col("request_body"), kind)).withColumn("request_body", F.col("_part.body"))
            held = F.col("request_body").isNotNull() & (F.size("_part.findings") > 0)
            if "request_body_hash" in rows.columns:
                r = r.withColumn("request_body_hash", F.when(~held, F.col("request_body_hash")))
            r = r.withColumn("_found", F.col("_found") + F.when(held, F.size("_part.findings")).otherwise(0)).drop("_part")
        record = privacy.sanitized_metadata(F.to_json(F.struct(*rows.columns)))
        r = materialized(r.select("_found", record.alias("_clean")).select((F.col("_found") + F.size("_clean.findings")).alias("_found"), F.from_json("_clean.json", kinds).alias("_record")))
        clean[name] = r.select("_record.*")
        counts.append(r.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("_found"), F.lit(0)).alias("redactions")).select(F.lit(name).alias("family"), "records", "redactions"))
    return clean, functools.reduce(DataFrame.unionByName, counts)


def private_artifacts(resources: DataFrame, *, on_risk: str = "exclude") -> DataFrame:
    """Resources (url, mime_type, text, content_hash) that may go into an archive.

    Finds in URLs are replaced and the content hash goes; with any other find a resource is left out (on_risk "exclude") or marked
    ("mark") for the caller to fail on.
    """
    r = resources.withColumn("_clean", privacy.sanitized_text(F.col("text")))
    r = r.withColumn("_risk", privacy.runnable(F.col("mime_type"), F.col("_clean")))
    clean = F.col("_risk.safe_to_sanitize")
    r = r.withColumn("text", F.when(clean, F.col("_clean.text")).otherwise(F.col("text"))).withColumn("content_hash", F.when(clean, F.lit(None).cast("string")).otherwise(F.col("content_hash")))
    r = r.withColumn("risky", F.col("_risk.risky") & ~clean).withColumn("sanitized", clean).drop("_clean", "_risk")
    return r.where("not risky").drop("risky") if on_risk == "exclude" else r
