"""Whole capture graphs, derived from pages and events with every rule broken somewhere, and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph
from ..sources import capture


def _id(family: str, k: str = "k") -> str:
    return f"concat('{family}-', {k})"


def _lost(valid: str, every: int, name: str) -> str:
    """A reference, lost in one of so many rows."""
    return f"CASE WHEN k % {every} = {every - 1} THEN concat('lost-{name}-', k) ELSE {valid} END"


def _other(family: str, step: int) -> str:
    """The id of an earlier row of the same graph, if there is one."""
    return f"CASE WHEN k >= {5 * step} THEN {_id(family, f'k - {5 * step}')} END"


def _list(*ids: str) -> str:
    """A list of ids that Spark and DuckDB write alike."""
    return f"split(concat_ws(',', {', '.join(ids)}), ',')"


_PAGE = "concat('{}-', user_id - user_id % 5 + k % 5)"
_MISSION = ("mission_id", _lost("concat('mission-', k % 5)", 83, "mission"))
_ACQUISITION = (
    ("provenance", "CASE WHEN k % 31 = 2 THEN 'rumour' ELSE 'refetched' END"), ("mission_id", "CASE WHEN k % 37 = 3 THEN 'mission-none' ELSE concat('mission-', k % 5) END"),
    ("response_id", "CASE WHEN k % 41 = 4 THEN concat('body-', k) ELSE concat('response-', k) END"), ("evidence_refs", f"CASE WHEN k % 43 = 5 THEN {_list(_id('body'), _id('acquired'))} END"),
)
#: Of each family the table its rows are of (k numbers them, sha hashes the text) and its columns. Five graphs share the rows; a page's records are in one graph.
_FAMILIES: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "missions": ("pages", (("id", _id("mission")), ("evidence_refs", _list(_id("target"), "'lost-evidence'")))),
    "targets": ("pages", (("id", f"CASE WHEN k % 101 = 9 THEN concat('request-', k) WHEN k % 103 = 10 THEN '' ELSE {_id('target')} END"), _MISSION, ("parent_target_id", _lost(_other("target", 1), 41, "parent")))),
    "requests": ("events", (
        ("id", _id("request")), _MISSION, ("target_id", _lost(_PAGE.format("target"), 37, "target")), ("source_target_id", _lost("''", 43, "source")), ("redirect_predecessor_request_id", _lost(_other("request", 1), 47, "before")),
        ("redirect_successor_request_id", _lost("NULL", 53, "after")), ("request_body_hash", "CASE WHEN k % 59 = 0 THEN 'sha256:XYZ' WHEN event_type = 'purchase' THEN concat('sha256:', sha) WHEN k % 2 = 0 THEN '' END"),
        ("evidence_refs", f"CASE WHEN k % 61 = 0 THEN {_list(_PAGE.format('target'), _id('response'), repr(''))} WHEN k % 61 = 1 THEN {_list(_id('response'), _id('lost'), _id('lost'))} END"),
    )),
    "responses": ("events", (
        ("id", _id("response")), _MISSION, ("request_id", _lost(_id("request"), 31, "request")), ("target_id", _lost("NULL", 67, "target")), ("source_target_id", _lost(_PAGE.format("target"), 71, "source")),
        ("body_id", _lost(_PAGE.format("body"), 29, "body")), ("redirect_successor_request_id", _lost(_id("request"), 79, "after")), ("content_hash", "CASE WHEN k % 61 = 2 THEN 'md5:1' WHEN k % 2 = 0 THEN '' END"),
        ("body_state", "CASE WHEN k % 83 = 0 THEN 'partial' WHEN k % 83 = 1 THEN NULL ELSE 'stored' END"),
    )),
    "bodies": ("pages", (
        ("id", _id("body")), _MISSION, ("content_hash", "CASE WHEN k % 17 = 3 THEN NULL ELSE concat('sha256:', sha) END"), ("size", "CASE WHEN k % 19 = 4 THEN -1 WHEN k % 19 = 5 THEN NULL ELSE length(html) END"),
        ("storage_key", "CASE WHEN k % 2 = 0 THEN concat('key-', k) END"), ("body", "CASE WHEN k % 4 = 1 THEN html END"), ("response_ids", _list(_id("response"), f"CASE WHEN k % 23 = 0 THEN {_id('request')} ELSE '' END")), ("acquisitions", "acquired"),
    )),
    "documents": ("pages", (
        ("id", _id("document")), _MISSION, ("target_id", _lost(_id("target"), 13, "target")), ("response_id", _lost(_id("response"), 17, "response")), ("body_id", _lost(_id("body"), 19, "body")), ("route_id", _lost(_id("route"), 23, "route")),
        ("snapshot_version", "CASE WHEN k % 11 = 0 THEN 2 WHEN k % 11 = 1 THEN 1 END"),
    )),
    "routes": ("pages", (
        ("id", _id("route")), _MISSION, ("discovered_from_route_id", _lost(_other("route", 2), 31, "from")), ("target_id", _lost("NULL", 37, "target")), ("document_id", _lost(_id("document"), 41, "document")),
        ("alias_route_ids", f"CASE WHEN k % 7 = 0 THEN {_list(_id('route'), _lost(repr(''), 15, 'alias'))} END"), ("transition_kind", "CASE WHEN k % 43 = 0 THEN 'jump' WHEN k % 2 = 0 THEN 'history' ELSE 'document' END"),
        ("state", "CASE WHEN k % 73 = 0 THEN 'lost' WHEN k % 3 = 0 THEN 'skipped' ELSE 'captured' END"), ("decision_reason", "CASE WHEN k % 9 = 0 THEN 'budget' WHEN k % 9 = 3 THEN '' END"),
    )),
    "dependency_edges": ("events", (("id", _id("edge")), _MISSION, ("owner_evidence_id", _lost(_id("response"), 47, "owner")), ("target_evidence_id", _lost(_id("request"), 53, "goal")))),
    "api_exchanges": ("events", (("id", f"CASE WHEN k % 107 = 3 THEN NULL ELSE {_id('exchange')} END"), _MISSION, ("request_id", _lost(_id("request"), 59, "request")), ("response_id", _lost(_id("response"), 61, "response")))),
    "derived_artifacts": ("pages", (("id", f"CASE WHEN k % 29 = 6 THEN {_id('artifact', 'k - 5')} ELSE {_id('artifact')} END"), _MISSION, ("body_id", _lost(_id("body"), 43, "body")), ("input_evidence_ids", _list(_id("body"), _lost(_id("document"), 47, "input"))))),
    "diagnostics": ("pages", (("id", _id("diagnostic")), _MISSION, ("evidence_refs", f"CASE WHEN k % 2 = 0 THEN {_list(_id('artifact'), _id('page'))} END"))),
}
_COMMON = (("graph_id", "concat('graph-', k % 5)"), ("provenance", "CASE WHEN k % 97 = 5 THEN 'guessed' WHEN k % 89 = 7 THEN NULL ELSE 'observed' END"))


def _rows(family: str, tables: dict[str, str], sha: str, acquired: str) -> str:
    table, columns = _FAMILIES[family]
    rows = "SELECT page_id AS k, html, {sha} AS sha FROM {pages}" if table == "pages" else "SELECT event_id AS k, user_id, event_type, {sha} AS sha FROM {events}"
    rows = rows.format(sha=sha.format("html" if table == "pages" else "props"), **tables) + (" WHERE page_id < 5" if family == "missions" else "")
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in (*_COMMON, *columns))} FROM ({rows})".replace("acquired AS", f"{acquired} AS")


def families(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All families of the planted graphs."""
    acquired = f"array(named_struct({', '.join(f'{n!r}, {e}' for n, e in _ACQUISITION)}))"
    tables = {t: f"parquet.`{sf}/{t}.parquet`" for t in ("pages", "events")}
    return {f: spark.sql(_rows(f, tables, "sha2({}, 256)", acquired)) for f in _FAMILIES}


def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.violations(families(spark, sf), capture.PROVENANCES, graph_col="graph_id")


QUERIES = {"graph_integrity": graph_integrity}


def _sql() -> str:
    """The same with an anti-join for each reference and a selection for each rule."""
    acquired = f"[{{{', '.join(f'{n!r}: {e}' for n, e in _ACQUISITION)}}}]"
    views = [f"{f} AS MATERIALIZED ({_rows(f, {'pages': 'pages', 'events': 'events'}, 'sha256({})', acquired)})" for f in _FAMILIES]
    views.append("ids AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT graph_id, id, '{f}' AS family FROM {f} WHERE coalesce(id, '') <> ''" for f in _FAMILIES) + ")")
    parts = ["SELECT graph_id, 'duplicate-id' AS rule, min(family) AS family, id, CAST(count(*) AS VARCHAR) AS detail FROM ids GROUP BY graph_id, id HAVING count(*) > 1"]

    def broken(rule: str, family: str, holds: str, detail: str = "NULL", rows: str = "") -> None:
        parts.append(f"SELECT graph_id, '{rule}', '{family}', id, CAST({detail} AS VARCHAR) FROM {rows or family} WHERE {holds}")

    known = ", ".join(f"'{p}'" for p in capture.PROVENANCES)
    for f, (_, columns) in _FAMILIES.items():
        broken("missing-id", f, "coalesce(id, '') = ''")
        broken("unknown-provenance", f, f"coalesce(provenance, '') NOT IN ({known})", "provenance")
        there = {n for n, _ in columns}
        for column, target in [*[r for r in (("mission_id", "missions"), ("evidence_refs", "any")) if f != "missions" or r[1] == "any"], *[(c, t) for o, c, t in graph.REFERENCES if o == f]]:
            outer, _, inner = column.partition(".")
            if outer not in there:
                continue
            listed = column in ("evidence_refs", "response_ids", "alias_route_ids", "input_evidence_ids", "acquisitions.evidence_refs")
            rows = f"(SELECT graph_id, id, unnest(acquisitions).{inner} AS x FROM {f})" if inner else f"(SELECT graph_id, id, {column} AS x FROM {f})"
            rows = f"(SELECT graph_id, id, unnest(x) AS x FROM {rows})" if listed else rows
            asked = "true" if listed and target == "any" else "coalesce(x, '') <> ''"
            family = "" if target == "any" else f" AND i.family = '{target}'"
            broken(f"dangling-{column.replace('_', '-').replace('.', '-')}", f, f"{asked} AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.graph_id = r.graph_id AND i.id = coalesce(r.x, ''){family})", "coalesce(x, '')", f"{rows} r")
    form = "coalesce({0}, '') <> '' AND NOT regexp_matches({0}, '^sha256:[0-9a-f]{{64}}$')"
    broken("request-body-hash-form", "requests", form.format("request_body_hash"), "request_body_hash")
    broken("content-hash-form", "responses", form.format("content_hash"), "content_hash")
    broken("content-hash-form", "bodies", "content_hash IS NULL", "content_hash")
    broken("negative-size", "bodies", "coalesce(size, -1) < 0", "size")
    broken("body-without-bytes", "bodies", "storage_key IS NULL AND body IS NULL")
    broken("acquisition-provenance", "bodies", f"x NOT IN ({known})", "x", "(SELECT graph_id, id, unnest(acquisitions).provenance AS x FROM bodies)")
    broken("snapshot-version", "documents", "snapshot_version <> 1", "snapshot_version")
    broken("body-state", "responses", "coalesce(body_state, '') NOT IN ('pending', 'stored', 'unavailable', 'not-captured', 'not-applicable')", "body_state")
    broken("transition-kind", "routes", "transition_kind = 'jump'", "transition_kind")
    broken("route-state", "routes", "state = 'lost'", "state")
    broken("skipped-without-reason", "routes", "state = 'skipped' AND coalesce(decision_reason, '') = ''")
    return f"WITH {', '.join(views)} {' UNION ALL '.join(parts)}"


ORACLE_SQL = {"graph_integrity": _sql()}
