"""Projections of the capture graph, its report and its validator."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media, paths
from ..sources.tables import materialized
from . import ranks

REPLAYED_WITHOUT_BODY = (204, 205, 301, 302, 303, 307, 308)
BODY_STATES = ("pending", "stored", "unavailable", "not-captured", "not-applicable")
ROUTE_STATES = ("discovered", "accepted", "visiting", "captured", "skipped", "failed")


def first_body_per_url(responses: DataFrame) -> DataFrame:
    """Of each URL the body that was complete first; whether any response of the URL was a Fetch or XHR."""
    held = responses.where(F.col("body_id").isNotNull() & (F.col("normalized_url") != ""))
    first = F.min_by(F.struct("content_hash", "size", "mime_type", F.col("id").alias("response_id"), "request_id"), F.struct("ts", "sequence"))
    fetched = F.bool_or(F.col("resource_type").isin("Fetch", "XHR"))
    return held.groupBy(F.col("normalized_url").alias("url")).agg(first.alias("first"), fetched.alias("preserve_url")).select("url", "first.*", "preserve_url")


def api_snapshots(exchanges: DataFrame) -> DataFrame:
    """First successful exchange with a body of each (method, URL, posted data), in the order in which bodies were stored."""
    good = exchanges.where(F.col("body_id").isNotNull() & F.col("status").between(200, 299)).withColumn("post_data", F.coalesce("request_body", F.lit("")))
    order = Window.partitionBy("method", "normalized_url", "post_data").orderBy("ts", "sequence")
    return good.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def by_language(text: str) -> Column:
    """A text in the order of languages: letters before case and accents, which only tell equal ones apart."""
    return F.collate(F.col(text), "UNICODE")


def replay_exchanges(exchanges: DataFrame) -> DataFrame:
    """Exchanges as they are replayed, in the order of (sequence, exchange id), ids as languages order them; an absent request body has the hash of the empty one."""
    return exchanges.orderBy("sequence", by_language("exchange_id"), "exchange_id").select(
        "exchange_id", "sequence", "method", F.col("normalized_url").alias("url"), "content_type", F.coalesce("request_body_hash", F.lit(paths.EMPTY_HASH)).alias("request_body_hash"),
        F.coalesce("request_body", F.lit("")).alias("post_data"), "status", "mime_type", "content_hash", F.col("body_id").isNotNull().alias("body_available"), "provenance",
    )


def miss_reason(url: Column, resource_type: Column, headers: Column, method: Column, body_state: Column, status: Column) -> Column:
    """Why a recorded exchange can't be replayed, by the first rule that holds; null if it can."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    content_type = media.header(headers, "content-type")
    posted = F.rlike(F.lower(content_type), F.lit("^(application/json|application/x-www-form-urlencoded|multipart/form-data)(;|$)"))
    return (
        F.when(scheme == "", "invalid-request-url")
        .when(~scheme.isin("http", "https"), "unsupported-url-scheme")
        .when((resource_type == "WebSocket") | (media.header(headers, "upgrade") == "websocket"), "websocket")
        .when(F.contains(F.lower(media.header(headers, "accept")), F.lit("text/event-stream")), "sse")
        .when(media.header(headers, "range") != "", "range-request")
        .when(~method.isin("GET", "HEAD", "POST"), "unknown-mutation")
        .when((method == "POST") & (content_type != "") & ~posted, "unsupported-post-content-type")
        .when((body_state != "stored") & ~status.isin(*REPLAYED_WITHOUT_BODY), "response-body-unavailable")
    )


def provenance_counts(records: dict[str, DataFrame], provenances: tuple[str, ...]) -> DataFrame:
    """Records of each family by provenance, 0 where there are none."""
    spark = next(iter(records.values())).sparkSession
    families = [df.groupBy("provenance").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(name)) for name, df in records.items()]
    counted = functools.reduce(DataFrame.unionByName, families)
    every = spark.createDataFrame([(f, p) for f in records for p in provenances], "family string, provenance string")
    return every.join(counted, ["family", "provenance"], "left").select("family", "provenance", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def body_provenance(responses: DataFrame) -> DataFrame:
    """Bodies by the provenances of their acquisitions, each body once for each."""
    return responses.where("body_id is not null").groupBy("provenance").agg(F.count_distinct("body_id").alias("bodies"))


def record_counts(families: dict[str, DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(name)) for name, df in families.items()]).select("family", "n")


def variant_rows(requests: DataFrame) -> DataFrame:
    """Requests (normalized_url, sequence, id, method, request_body_hash, provenance) of URLs that were requested more than once, a row each: (url, n, place, id, method, ...). A URL of many requests is many tasks."""
    rows = materialized(requests.select(F.col("normalized_url").alias("url"), "sequence", "id", "method", "request_body_hash", "provenance").where("url is not null"))
    several = materialized(rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("asked", F.col("n")))
    return ranks.ranked(ranks.joined(rows, several, ["url"], "asked"), ["url"], ["sequence", "id"], "place").drop("sequence")


def request_variants(requests: DataFrame) -> DataFrame:
    """URLs that were requested more than once, with their variants in order, as a report lists them; variant_rows has no list in a row."""
    variants = F.array_sort(F.collect_list(F.struct("sequence", "id", "method", "request_body_hash", "provenance")))
    return requests.groupBy(F.col("normalized_url").alias("url")).agg(F.count(F.lit(1)).alias("n"), variants.alias("variants")).where("n > 1")


def body_aliases(responses: DataFrame) -> DataFrame:
    """Bodies that several responses share."""
    held = responses.where("body_id is not null")
    return held.groupBy("body_id").agg(F.first("content_hash").alias("content_hash"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_responses"), F.count_distinct("normalized_url").alias("n_urls"), F.min("sequence").alias("first_sequence")).where("n_responses > 1")


def rendered_pages(routes: DataFrame, documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """Captured routes with the bodies of their documents, each also for its aliases."""
    pages = routes.where("state = 'captured'").join(documents.select(F.col("id").alias("document_id"), "body_id"), "document_id").join(bodies.select(F.col("id").alias("body_id"), "content_hash", "size"), "body_id")
    return pages.withColumn("route", F.explode(F.array_union(F.array("id"), F.coalesce("alias_route_ids", F.array().cast("array<string>"))))).select(F.col("route").alias("route_id"), F.col("id").alias("owner_route_id"), "route_url", "content_hash", "size")


def closure(links: DataFrame, resources: DataFrame) -> DataFrame:
    """What URLs lead to over alias and redirect links: (url, resource, hops), null where the chain ends elsewhere or turns in a circle.

    links: (url, target, kind); of two links of a URL the alias goes first. A URL that is a resource leads to itself. Each round
    doubles the hops that are followed until every chain has ended; what goes on after as many hops as there are links turns in a circle.
    """
    order = Window.partitionBy("url").orderBy(F.when(F.col("kind") == "alias", 0).otherwise(1), "target")
    known = resources.select("url").distinct()
    link = links.withColumn("n", F.row_number().over(order)).where("n = 1").select("url", "target").join(known, "url", "left_anti")
    every = link.select("url").union(link.select("target")).union(known).distinct()
    step = every.join(link, "url", "left").select("url", F.coalesce("target", "url").alias("at"), F.col("target").isNotNull().cast("long").alias("hops"))
    most, followed = link.count(), 1
    step = materialized(step.withColumn("more", F.col("hops")))
    while followed < most and not step.where("more > 0").isEmpty():
        onward = step.select(F.col("url").alias("at"), F.col("at").alias("further"), F.col("hops").alias("more"))
        step = materialized(step.drop("more").join(onward, "at").select("url", F.col("further").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), "more"))
        followed *= 2
    asked = links.select("url").union(known).distinct()
    ends = step.join(known.select(F.col("url").alias("resource")), F.col("at") == F.col("resource")).select("url", "resource", "hops")
    return asked.join(ends, "url", "left")


#: Which column of which family leads to which family (any: to a record of whatever family). Columns of lists lead there with each entry; a dot goes into structs.
REFERENCES = (
    ("targets", "parent_target_id", "targets"), ("requests", "target_id", "targets"), ("requests", "source_target_id", "targets"), ("requests", "redirect_predecessor_request_id", "requests"),
    ("requests", "redirect_successor_request_id", "requests"), ("responses", "request_id", "requests"), ("responses", "target_id", "targets"), ("responses", "source_target_id", "targets"),
    ("responses", "body_id", "bodies"), ("responses", "redirect_successor_request_id", "requests"), ("bodies", "response_ids", "responses"), ("bodies", "acquisitions.mission_id", "missions"),
    ("bodies", "acquisitions.response_id", "responses"), ("bodies", "acquisitions.evidence_refs", "any"), ("api_exchanges", "request_id", "requests"), ("api_exchanges", "response_id", "responses"),
    ("documents", "target_id", "targets"), ("documents", "response_id", "responses"), ("documents", "body_id", "bodies"), ("documents", "route_id", "routes"),
    ("routes", "discovered_from_route_id", "routes"), ("routes", "target_id", "targets"), ("routes", "document_id", "documents"), ("routes", "alias_route_ids", "routes"),
    ("dependency_edges", "owner_evidence_id", "any"), ("dependency_edges", "target_evidence_id", "any"), ("derived_artifacts", "body_id", "bodies"), ("derived_artifacts", "input_evidence_ids", "any"),
)
#: What every family has beside these, and the versions a reader knows.
COMMON_REFERENCES = (("mission_id", "missions"), ("evidence_refs", "any"))
SCHEMA_VERSION, SNAPSHOT_VERSION = 1, 1


def violations(families: dict[str, DataFrame], provenances: tuple[str, ...], *, graph_col: str | None = None) -> DataFrame:
    """Broken rules of graphs: (rule, family, id, detail), and the graph where graph_col names the column of each family that tells the graphs apart.

    Ids are there and unique over all families of a graph, provenances are known (also of a body's acquisitions), references lead to records of their family, evidence to any
    record, hashes have their form, sizes aren't negative, bodies are stored or inline, states, transitions and snapshot versions are known, and skipped routes have a
    reason. No reference is one that is null or empty; an empty entry in a list of evidence is a lost one. Columns that a family doesn't have aren't asked about.

    Each family is read once, for its ids, references and faults as rows of one stored table. Ids and what leads to them meet in one aggregation of bits and counts; what is
    lost is joined back to its records, frequent ids by sending them to all tasks.
    """
    order = sorted({*families, *(t for _, _, t in REFERENCES), *(t for _, t in COMMON_REFERENCES)} - {"any"})  # a family is its bit here; the last is any
    found = [_facts(name, df, provenances, graph_col, order) for name, df in families.items()]
    facts = materialized(functools.reduce(DataFrame.unionByName, found))
    is_id = F.col("kind") == "id"
    known = facts.where("kind <> 'fault'").groupBy("graph", "ref").agg(
        F.count_if(is_id).alias("n"), F.min(F.when(is_id, F.col("place"))).alias("first"), F.coalesce(F.bit_or(F.when(is_id, F.expr("shiftleft(1L, place)"))), F.lit(0)).alias("there"),
        F.coalesce(F.bit_or(F.when(~is_id, F.expr("shiftleft(1L, place)"))), F.lit(0)).alias("wanted"), F.count_if(~is_id).alias("asked"),
    )
    lost = F.expr(f"if(n = 0, wanted, wanted & ~there & ~shiftleft(1L, {len(order)}))")
    known = materialized(known.withColumn("lost", lost).where("n > 1 or lost <> 0"))
    family = F.element_at(F.array(*[F.lit(f) for f in order]), F.col("first") + 1)
    repeated = known.where("n > 1").select("graph", F.lit("duplicate-id").alias("rule"), family.alias("family"), F.col("ref").alias("id"), F.col("n").cast("string").alias("detail"))
    every_lost = known.where("lost <> 0").select("graph", "ref", F.explode(F.expr(f"filter(sequence(0, {len(order)}), w -> (shiftright(lost, w) & 1) = 1)")).alias("place"), "asked")
    dangling = ranks.joined(facts.where("kind = 'reference'"), every_lost.hint("shuffle_hash"), ["graph", "ref", "place"], "asked").select("graph", "rule", "family", "id", F.col("ref").alias("detail"))
    faults = facts.where("kind = 'fault'").select("graph", "rule", "family", "id", "detail")
    every = repeated.unionByName(dangling).unionByName(faults)
    return every.withColumnRenamed("graph", graph_col) if graph_col else every.drop("graph")


def header_violations(graphs: DataFrame, schema_name: str) -> DataFrame:
    """Graphs (graph, schema_name, schema_version, minimum_reader_version) that a reader of a schema can't take: (graph, rule, detail). Of another schema nothing else is told."""
    name, version, least = F.col("schema_name"), F.col("schema_version"), F.col("minimum_reader_version")
    ours = F.coalesce(name == schema_name, F.lit(False))
    rules = [("schema-name", ~ours, name), ("schema-version", ours & ~F.coalesce(version == SCHEMA_VERSION, F.lit(False)), version), ("minimum-reader-version", ours & ~F.coalesce(least <= SCHEMA_VERSION, F.lit(False)), least)]
    broken = F.array(*[F.when(holds, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, holds, detail in rules])
    return graphs.select("graph", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("fault")).select("graph", "fault.*")


def _facts(family: str, rows: DataFrame, provenances: tuple[str, ...], graph_col: str | None, order: list[str]) -> DataFrame:
    """(graph, family, id, kind, rule, ref, place, detail): the ids, references and faults of a family's rows, in one pass; place: an id's own family in the order, or the one a reference wants."""
    none = F.lit(None).cast("string")
    at = lambda wanted: len(order) if wanted == "any" else order.index(wanted)
    fact = lambda kind, rule, ref, wants, detail: F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), ref.cast("string").alias("ref"), F.lit(at(wants)).alias("place"), detail.cast("string").alias("detail"))
    reference = lambda rule, target, x: fact("reference", rule, F.coalesce(x, F.lit("")), target, none)
    own = [F.when(F.coalesce(F.col("id"), F.lit("")) != "", fact("id", "", F.col("id"), family, none))]
    own += [F.when(holds, fact("fault", rule, none, family, detail)) for rule, holds, detail in _row_rules(family, rows, provenances)]
    lists = []
    mentioned = [*COMMON_REFERENCES[family == "missions" :], *((column, target) for owner, column, target in REFERENCES if owner == family)]
    for column, target in mentioned:
        if (refs := _references(rows, column)) is None:
            continue
        rule = f"dangling-{column.replace('_', '-').replace('.', '-')}"
        told, is_list = refs
        if told is None:
            own.append(F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", reference(rule, target, F.col(column))))
            continue
        there = (lambda x: F.lit(True)) if is_list and target == "any" else (lambda x: F.coalesce(x, F.lit("")) != "")
        lists.append(F.transform(F.filter(told, there), functools.partial(reference, rule, target)))
    if family == "bodies" and "acquisitions" in rows.columns:
        unknown = F.filter(F.coalesce("acquisitions", F.array()), lambda a: ~F.coalesce(a["provenance"], F.lit("")).isin(*provenances))
        lists.append(F.transform(unknown, lambda a: fact("fault", "acquisition-provenance", none, family, a["provenance"])))
    every = F.concat(F.array(*own), *lists)
    graph = F.col(graph_col).cast("string") if graph_col else F.lit("")
    return rows.select(F.coalesce(graph, F.lit("")).alias("graph"), F.lit(family).alias("family"), F.col("id").cast("string").alias("id"), F.explode(every).alias("fact")).where("fact is not null").select("graph", "family", "id", "fact.*")


def _references(rows: DataFrame, column: str) -> tuple[Column | None, bool] | None:
    """The ids in a column as a list (None for a column of single ids), and whether it holds lists; none if the rows have no such column."""
    name, _, inner = column.partition(".")
    if name not in rows.columns:
        return None
    kind = rows.schema[name].dataType
    if inner:
        field = next((f for f in kind.elementType.fields if f.name == inner), None)
        if field is None:
            return None
        ids = F.transform(F.coalesce(name, F.array()), lambda a: a[inner])
        listed = isinstance(field.dataType, T.ArrayType)
        return (F.flatten(F.transform(ids, lambda x: F.coalesce(x, F.array()))) if listed else ids), listed
    if isinstance(kind, T.ArrayType):
        return F.coalesce(name, F.array().cast(kind)), True
    return None, False


def _row_rules(family: str, rows: DataFrame, provenances: tuple[str, ...]) -> list[tuple[str, Column, Column]]:
    """(rule, whether a row breaks it, detail) for the columns that the rows of a family have."""
    none, text = F.lit(None).cast("string"), lambda name: F.coalesce(F.col(name), F.lit(""))
    rules = [("missing-id", text("id") == "", none)]
    if "provenance" in rows.columns:
        rules.append(("unknown-provenance", ~text("provenance").isin(*provenances), F.col("provenance")))
    if family == "bodies":
        rules.append(("content-hash-form", ~F.coalesce(F.rlike("content_hash", F.lit("^sha256:[0-9a-f]{64}$")), F.lit(False)), F.col("content_hash")))
        rules.append(("negative-size", F.coalesce("size", F.lit(-1)) < 0, F.col("size")))
        if "storage_key" in rows.columns and "body" in rows.columns:
            rules.append(("body-without-bytes", F.col("storage_key").isNull() & F.col("body").isNull(), none))
    form = lambda name: ~F.rlike(name, F.lit("^sha256:[0-9a-f]{64}$"))
    if family == "requests" and "request_body_hash" in rows.columns:
        rules.append(("request-body-hash-form", (text("request_body_hash") != "") & form("request_body_hash"), F.col("request_body_hash")))
    if family == "responses" and "content_hash" in rows.columns:
        rules.append(("content-hash-form", (text("content_hash") != "") & form("content_hash"), F.col("content_hash")))
    if family == "documents" and "snapshot_version" in rows.columns:
        rules.append(("snapshot-version", F.coalesce(F.col("snapshot_version") != SNAPSHOT_VERSION, F.lit(False)), F.col("snapshot_version")))
    if family == "responses":
        rules.append(("body-state", ~text("body_state").isin(*BODY_STATES), F.col("body_state")))
    if family == "routes":
        rules.append(("transition-kind", ~text("transition_kind").isin("document", "history"), F.col("transition_kind")))
        rules.append(("route-state", ~text("state").isin(*ROUTE_STATES), F.col("state")))
        rules.append(("skipped-without-reason", (F.col("state") == "skipped") & (text("decision_reason") == ""), none))
    return rules
