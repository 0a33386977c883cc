"""Matching requests against recordings in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media, paths, urls
from ..sources.tables import materialized

POSTED_TYPES = ("application/json", "application/x-www-form-urlencoded", "multipart/form-data")


def unsupported_reason(url: Column, method: Column, headers: Column, *, destination: Column | None = None, initiator: Column | None = None, streaming: Column | None = None) -> Column:
    """Why a request can't be replayed at all, by the first rule that holds; empty if it can. A null url is no fault."""
    nothing, no = F.lit(""), F.lit(False)
    destination, initiator, streaming = destination if destination is not None else nothing, initiator if initiator is not None else nothing, streaming if streaming is not None else no
    verb = F.upper(F.coalesce(method, F.lit("GET")))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    kind = media.normalized_type(media.header(headers, "content-type"))
    return (
        F.when(url.isNotNull() & (scheme == ""), "invalid-request-url")
        .when(url.isNotNull() & ~scheme.isin("http", "https"), "unsupported-url-scheme")
        .when((F.lower(media.header(headers, "upgrade")) == "websocket") | (destination == "websocket"), "websocket")
        .when(F.contains(F.lower(media.header(headers, "accept")), F.lit("text/event-stream")), "sse")
        .when(media.header(headers, "range") != "", "range-request")
        .when((destination == "beacon") | (initiator == "beacon"), "beacon")
        .when(streaming & ~verb.isin("GET", "HEAD"), "streaming-request")
        .when(~verb.isin("GET", "HEAD", "POST"), "unknown-mutation")
        .when((verb == "POST") & (kind != "") & ~kind.isin(*POSTED_TYPES), "unsupported-post-content-type")
        .otherwise("")
    )


_KEY = ["method", "url", "content_type", "body_hash"]


def match_in_order(requests: DataFrame, recordings: DataFrame, *, client: str | None = None) -> DataFrame:
    """Every request with the recording that it consumes: (request_id, exchange_id, reason_code).

    The n-th of a client's equal requests (method, URL, content type, body hash; in the order of ``position``) takes the n-th recording
    by sequence. Where that would be the first of several recordings of one sequence, it and all later ones are ambiguous and consume nothing.
    Exact where every path key has one URL; match_by_path handles the rest.

    requests: request_id, position, method, url, content_type, body_hash, unsupported[, client]; recordings: exchange_id, sequence and the key.
    """
    keyed = requests.withColumn("body_hash", F.coalesce("body_hash", F.lit(paths.EMPTY_HASH)))
    by_client = [client] if client else []
    asked = keyed.where("unsupported = ''").withColumn("r", F.row_number().over(Window.partitionBy(*by_client, *_KEY).orderBy("position", "request_id")))
    order, ties = Window.partitionBy(*_KEY).orderBy("sequence", "exchange_id"), Window.partitionBy(*_KEY, "sequence")
    held = recordings.withColumn("body_hash", F.coalesce("body_hash", F.lit(paths.EMPTY_HASH))).withColumn("r", F.row_number().over(order)).withColumn("tied", F.count(F.lit(1)).over(ties) > 1)
    groups = held.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("tied"), F.col("r"))).alias("stuck"))
    found = asked.join(groups, _KEY, "left").join(held.select(*_KEY, "r", "exchange_id"), [*_KEY, "r"], "left")
    reason = F.when(F.col("n").isNull(), "not-found").when(F.col("r") >= F.col("stuck"), "ambiguous").when(F.col("r") > F.col("n"), "repeat-exhausted").otherwise("")
    judged = found.withColumn("reason_code", reason).select("request_id", F.when(F.col("reason_code") == "", F.col("exchange_id")).alias("exchange_id"), "reason_code")
    refused = keyed.where("unsupported <> ''").select("request_id", F.lit(None).cast("string").alias("exchange_id"), F.col("unsupported").alias("reason_code"))
    return judged.unionByName(refused)


_PATH_KEY = ["method", "path_key", "content_type", "body_hash"]


def match_by_path(requests: DataFrame, recordings: DataFrame, runtime_origin: str) -> DataFrame:
    """As match_in_order per client, and requests to the runtime's own origin that no recording fits exactly may take one of the same path.

    If recordings of the path come from several origins such a request is ambiguous; if all are of one URL it counts as a request to that URL. Only where a
    path of one origin has several URLs do exact and path requests share recordings that can't be ranked apart: those of a client are walked in order.
    """
    shaped = lambda df: df.withColumn("body_hash", F.coalesce("body_hash", F.lit(paths.EMPTY_HASH))).withColumn("path_key", urls.path_key(F.col("url"))).withColumn("origin", urls.origin(F.col("url")))
    requests = materialized(requests)
    asked, held = shaped(requests.where("unsupported = ''")), materialized(shaped(recordings))
    by_path = held.groupBy(*_PATH_KEY).agg(F.count_distinct("origin").alias("origins"), F.count_distinct("url").alias("n_urls"), F.min("url").alias("only_url"))
    exact = held.select(*_PATH_KEY, "url").distinct().withColumn("exact", F.lit(True))
    asked = asked.join(exact, [*_PATH_KEY, "url"], "left").join(by_path, _PATH_KEY, "left")
    loose = F.col("exact").isNull() & (F.col("origin") == runtime_origin) & F.col("origins").isNotNull()
    unsure = asked.where(loose & (F.col("origins") > 1)).select("request_id", F.lit(None).cast("string").alias("exchange_id"), F.lit("ambiguous").alias("reason_code"))
    rest = asked.where(~(loose & (F.col("origins") > 1))).withColumn("shared", loose & (F.col("n_urls") > 1)).withColumn("url", F.when(loose & (F.col("n_urls") == 1), F.col("only_url")).otherwise(F.col("url")))
    rest = materialized(rest.select("request_id", "position", "client", "url", *_PATH_KEY, "unsupported", "shared"))
    walked = materialized(rest.where("shared").select("client", *_PATH_KEY).distinct())
    ranked = match_in_order(rest.join(walked, ["client", *_PATH_KEY], "left_anti"), held, client="client")
    refused = requests.where("unsupported <> ''").select("request_id", F.lit(None).cast("string").alias("exchange_id"), F.col("unsupported").alias("reason_code"))
    return ranked.unionByName(unsure).unionByName(_walked(rest.join(walked, ["client", *_PATH_KEY], "left_semi"), held.join(walked, _PATH_KEY))).unionByName(refused)


def _walked(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Requests of each (client, path) in order against its recordings; rows come sorted, recordings first, and only the recordings of one path are held."""
    kinds = asked.schema["position"].dataType.simpleString()
    rows = asked.select("client", *_PATH_KEY, "url", F.lit(1).alias("kind"), "position", F.lit(0).cast("long").alias("sequence"), F.col("request_id").alias("id")).unionByName(
        held.select("client", *_PATH_KEY, "url", F.lit(0).alias("kind"), F.lit(None).cast(kinds).alias("position"), F.col("sequence").cast("long").alias("sequence"), F.col("exchange_id").alias("id"))
    )
    key = ["client", *_PATH_KEY]
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "kind", "position", "sequence", "id").select(F.struct(*key).cast("string").alias("key"), "url", "kind", "sequence", "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lists, heads, used = None, {}, {}, set()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.key != current:
                    current, lists, heads, used = r.key, {}, {}, set()
                if r.kind == 0:
                    for name in (None, r.url):  # all recordings of the path, and those of each URL
                        lists.setdefault(name, []).append((r.sequence, r.id))
                    continue
                name = r.url if r.url in lists else None
                own, at = lists[name], heads.get(name, 0)
                while at < len(own) and own[at][1] in used:
                    at += 1
                heads[name] = at
                following = next((x for x in itertools.islice(own, at + 1, None) if x[1] not in used), None) if at < len(own) else None
                if at == len(own):
                    out.append((r.id, None, "repeat-exhausted"))
                elif following and following[0] == own[at][0]:
                    out.append((r.id, None, "ambiguous"))
                else:
                    used.add(own[at][1])
                    out.append((r.id, own[at][1], ""))
            yield pd.DataFrame(out, columns=["request_id", "exchange_id", "reason_code"], dtype=object)

    return ordered.mapInPandas(walk, "request_id string, exchange_id string, reason_code string")


def ambiguity(exchanges: DataFrame) -> DataFrame:
    """Identities (method, path key, content type, body hash) that several origins answer."""
    keyed = exchanges.withColumn("path_key", urls.path_key(F.col("url"))).withColumn("origin", urls.origin(F.col("url")))
    return keyed.groupBy("method", "path_key", "content_type", "request_body_hash").agg(F.count_distinct("origin").alias("origins"), F.count(F.lit(1)).alias("candidates")).where("origins > 1")


def coverage(exchanges: DataFrame, misses: DataFrame, ambiguities: DataFrame | None = None) -> DataFrame:
    """One row: recorded, supported (no miss), locally_fulfillable (a body, or a status that needs none), coverage percent to a tenth (100 of nothing),
    ambiguities, and misses by reason, those of ambiguities included.

    exchanges: exchange_id[, body_available, status].
    """
    fulfilled = F.lit(None).cast("boolean")
    if "body_available" in exchanges.columns:
        fulfilled = F.col("body_available") | F.col("status").isin(204, 205, 301, 302, 303, 307, 308)
    marked = exchanges.withColumn("fulfilled", fulfilled).join(misses.select("exchange_id", "reason_code"), "exchange_id", "left")
    by_reason = marked.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"), F.count_if("fulfilled").alias("fulfilled"))
    if ambiguities is not None:
        by_reason = by_reason.unionByName(ambiguities.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("ambiguous").alias("reason_code"), "n", F.lit(None).cast("long").alias("fulfilled")))
    own = F.coalesce(F.col("reason_code") != "ambiguous", F.lit(True))
    sums = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason_code").isNotNull(), F.concat_ws("=", "reason_code", F.col("n").cast("string")))))
    n, ok = F.col("recorded"), F.col("supported")
    total = by_reason.agg(sums(F.when(own, F.col("n")), "recorded"), sums(F.when(F.col("reason_code").isNull(), F.col("n")), "supported"), sums("fulfilled", "locally_fulfillable"), sums(F.when(~own, F.col("n")), "ambiguities"), reasons.alias("misses"))
    return total.select("recorded", "supported", "locally_fulfillable", F.when(n > 0, F.floor((2000 * ok + n) / (2 * n)) / 10).otherwise(100.0).cast("double").alias("coverage"), "ambiguities", F.array_join("misses", ",").alias("misses"))
