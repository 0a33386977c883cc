"""Queries over references in pages and over secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy, urls
from ..operators import privacy as artifacts
from ..operators import references
from ..sources import capture
from ..sources.tables import dealt
from .views import REQUESTS, with_


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A whole table, dealt to all cores if it has few splits: what these queries do with a row costs far more than sending it."""
    return dealt(capture.table(spark, sf, name))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("owner"), F.col("url").alias("base_url"), F.col("html").alias("text"))


def html_references(spark: SparkSession, sf: str) -> DataFrame:
    return references.discover(_texts(spark, sf), "html").select("owner", "n", "syntax", "role", "raw_value", "resolved_url", "policy", "start", "end")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation references of pages, resolved: what the parser finds agrees with a plain pattern on these pages."""
    found = references.discover(_texts(spark, sf), "html").where("role = 'navigation' and tag = 'a'")
    return found.select(F.col("owner").cast("long").alias("page_id"), "raw_value")


def css_references(spark: SparkSession, sf: str) -> DataFrame:
    """Style sheets made from page ids (an import, a font, images, a set) before whole pages in a comment."""
    k = F.col("owner")
    sheet = F.concat(F.lit('@import "base'), k, F.lit('.css"; .a{background:url( \'i'), k, F.lit(".png' )} @font-face{src:url(f.woff2)} .b{background:image-set(\"s.png\" 1x, url(t.png) 2x)} /* url(no.png) "), "text", F.lit(" */"))
    return references.discover(_texts(spark, sf).withColumn("text", sheet), "css").select("owner", "n", "syntax", "role", "raw_value")


def js_references(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts made from page ids before whole pages in a comment."""
    k = F.col("owner")
    code = F.concat(F.lit('import x from "./m'), k, F.lit('.js"; // import "no"\nimport("/d.js"); s.src = "/e.js"; e.setAttribute("src", "/f.js"); const u = "https://h.test/i.png", t = `import("/no")`; /* '), "text", F.lit(" */"))
    return references.discover(_texts(spark, sf).withColumn("text", code), "javascript").select("owner", "n", "syntax", "role", "raw_value", "policy")


def srcset_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("owner")
    return references.discover(_texts(spark, sf).withColumn("text", F.concat(F.lit("a"), k, F.lit(".png 1x, data:image/png;base64,AA== 2x,b"), k, F.lit(".png 3x"))), "srcset").select("owner", "n", "raw_value")


def svg_references(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings made from page ids before whole pages in a comment."""
    k = F.col("owner")
    drawing = F.concat(F.lit('<svg><use xlink:href="#g'), k, F.lit('"/><image href="i.png"/><rect fill="url(p.svg#a)" mask="none"/></svg><!-- '), F.replace("text", F.lit("-->"), F.lit("- ->")), F.lit(" -->"))
    return references.discover(_texts(spark, sf).withColumn("text", drawing), "svg").select("owner", "n", "syntax", "role", "raw_value")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    pages = _texts(spark, sf)
    planted = pages.withColumn("text", F.concat(F.lit('<link rel="stylesheet" href="/lost.css"><img src="/i'), "owner", F.lit('.png"><script src="/s.js"></script>'), "text"))
    captured = pages.where("cast(owner as int) % 2 = 0").select(F.concat(urls.origin(F.col("base_url")), F.lit("/i"), "owner", F.lit(".png")).alias("url"), F.concat(F.lit("assets/i"), "owner", F.lit(".png")).alias("local_path"))
    return references.resolve(references.discover(planted, "html"), captured)


def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("owner", "n", "raw_value", "disposition", "reason", "replacement")


def reference_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return references.diagnostics(_resolved(spark, sf)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def rewritten_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = _texts(spark, sf).withColumn("text", F.concat(F.lit('<link rel="stylesheet" href="/lost.css"><img src="/i'), "owner", F.lit('.png"><script src="/s.js"></script>'), "text"))
    done = references.rewrite(pages, _resolved(spark, sf))
    return done.select("owner", references.with_bootstrap(references.without_foreign(F.col("text")), '<script src="/offline.js"></script>').alias("text"), "replaced")


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with a secret planted by doc_id behind them."""
    k = F.col("doc_id")
    secret = (
        F.when(k % 5 == 0, F.concat(F.lit(" Bearer abcdef"), k + 10_000_000)).when(k % 5 == 1, F.concat(F.lit(" AKIAABCDEFGH"), F.lpad(k.cast("string"), 8, "0"))).when(k % 5 == 2, F.concat(F.lit(" eyJabcdefgh.eyJabcdefgh.sig"), k + 10_000_000))
        .when(k % 5 == 3, F.concat(F.lit(" password=abcdefgh1"), k + 10_000)).otherwise("")
    )
    return _table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" note"), secret, F.lit(" end.")).alias("text"))


def secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = _planted(spark, sf).select("doc_id", F.explode(privacy.findings(F.col("text"), F.lit("text"))).alias("f"))
    return found.select("doc_id", "f.category", "f.confidence", "f.masked")


def redacted_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _planted(spark, sf).select("doc_id", privacy.redacted(F.col("text")).alias("text"))


def document_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """What the detectors find in whole documents, by category."""
    found = _table(spark, sf, "documents").select("doc_id", F.explode(privacy.findings(F.col("text"), F.lit("text"))).alias("f"))
    return found.groupBy("doc_id", F.col("f.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def sanitized_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of every request: where it comes from, with credentials and a token planted in the page's own URL, what it posts, and secrets of three kinds."""
    k, plain = F.col("event_id"), F.col("normalized_url")
    referer = F.concat(F.regexp_replace(plain, "^([a-z]+://)", "$1me:secret@"), F.when(F.contains(plain, F.lit("?")), "&").otherwise("?"), F.lit("token=abcd1234"), k)
    headers = F.create_map(F.lit("Cookie"), F.concat(F.lit("sid="), k), F.lit("X-Session-Token"), F.lit("abc"), F.lit("Accept"), F.col("content_type"), F.lit("X-Note"), F.concat(F.lit("Basic abcdefgh"), k), F.lit("Referer"), referer, F.lit("X-Body"), F.coalesce("request_body", F.lit("")))
    asked = capture.requests(spark, sf).select("event_id", "normalized_url", "content_type", "request_body").repartition(4 * spark.sparkContext.defaultParallelism)
    h = asked.select("event_id", privacy.sanitized_headers(headers).alias("h"))
    names = {"cookie": "Cookie", "session": "X-Session-Token", "accept": "Accept", "note": "X-Note", "referer": "Referer", "posted": "X-Body"}
    return h.select("event_id", *[F.col("h.headers")[name].alias(column) for column, name in names.items()], F.size("h.findings").alias("found"))


def sanitized_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' own URLs with credentials, parameters and fragments planted."""
    k, plain = F.col("page_id"), urls.normalized(F.col("url"))
    named = F.when(k % 3 == 0, F.regexp_replace(plain, "^([a-z]+://)", "$1me:secret@")).otherwise(plain)
    url = F.concat(named, F.when(F.contains(plain, F.lit("?")), "&").otherwise("?"), F.lit("token=abc"), k, F.lit("&code=x"), F.when(k % 4 == 0, "#access_token=1").otherwise("#top"))
    s = _table(spark, sf, "pages").select("page_id", privacy.sanitized_url(url).alias("s"))
    return s.select("page_id", "s.url", F.size("s.findings").alias("found"))


def sanitized_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies with secrets planted: JSON that names the page's URL, forms that name letters of it, and whole pages as text."""
    k, plain = F.col("page_id"), urls.normalized(F.col("url"))
    kind = F.when(k % 3 == 0, "application/json").when(k % 3 == 1, "application/x-www-form-urlencoded").otherwise("text/plain")
    as_json = F.concat(F.lit('{"user":{"password":"p'), k, F.lit('","name":"'), plain, F.lit('"},"list":[1,"Bearer abcdefgh1"]}'))
    form = F.concat(F.lit("name="), F.regexp_replace(plain, "[^a-z]", ""), F.lit("&api_key=k"), k)
    body = F.when(k % 3 == 0, as_json).when(k % 3 == 1, form).otherwise(F.concat("html", F.when(k % 2 == 0, "").otherwise(" token: abcdefgh12345")))
    s = _table(spark, sf, "pages").select("page_id", privacy.sanitized_body(body, kind).alias("s"))
    return s.select("page_id", F.sha2("s.body", 256).alias("body"), "s.safe", F.size("s.findings").alias("found"))


def sanitized_metadata(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "events").select("event_id", privacy.sanitized_metadata(F.concat(F.lit('{"session":"s","props":'), "props", F.lit(',"at":"https://u:p@h.test/?key=abcdefghijklmnop"}'))).alias("s"))
    return s.select("event_id", F.get_json_object("s.json", "$.session").alias("session"), F.get_json_object("s.json", "$.at").alias("at"), F.size("s.findings").alias("found"))


def sanitized_requests(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts.sanitized_requests(capture.requests(spark, sf)).select("id", "original_url", "request_body", "request_body_hash", "redactions")


def private_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    d = _planted(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 4, F.concat("text", F.lit(" see https://a.test/?token=abcd"), "doc_id")).otherwise(F.col("text")))
    return artifacts.private_artifacts(d.select("doc_id", F.lit("text/plain").alias("mime_type"), "text", F.lit("sha256:x").alias("content_hash"))).select("doc_id", "text", "content_hash", "sanitized")


_BROKEN = "page_id % 11 = 0"


def _typed_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages as they are and in style sheets, scripts and glTF documents around them; every eleventh breaks off."""
    p = _table(spark, sf, "pages")
    k, broken = F.col("page_id"), F.expr(_BROKEN)
    kinds = ("text/html", "text/css", "text/javascript", "model/gltf+json", "text/plain")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 5 + 1).cast("int"))
    css = F.concat(F.lit("@import '/known.css'; a{b:url(/i.png)} /* "), "html", F.when(broken, " ").otherwise(" */ /*# sourceMappingURL=x.map */"))
    js = F.concat(F.lit('import "/m.js"; import "/known.css"; /* '), "html", F.when(broken, "").otherwise(" */ //# sourceMappingURL=x.map"))
    file = F.concat(F.lit('{"title":'), F.to_json(F.struct(F.col("html").alias("h"))), F.lit(',"buffers":[{"uri":"/known.css"},{"uri":"data:x"}]}'))
    text = F.when(k % 5 == 0, F.concat(F.lit('<img src="/i.png">'), "html", F.when(broken, '<a href="').otherwise(""))).when(k % 5 == 1, css).when(k % 5 == 2, js).when(k % 5 == 3, file).otherwise(F.col("html"))
    return p.select(k.cast("string").alias("owner"), F.concat(F.lit("https://r.test/"), k).alias("url"), kind.alias("mime_type"), text.alias("text"), (k % 10 == 0).alias("route_page"))


def _rewritten(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = spark.createDataFrame([("https://r.test/known.css", "assets/old.css", 1), ("https://r.test/known.css", "assets/known.css", 2)], "url string, local_path string, position int")
    return references.rewrite_resources(_typed_resources(spark, sf), known, "<script src=/b.js></script>")


def rewritten_resources(spark: SparkSession, sf: str) -> DataFrame:
    out = _rewritten(spark, sf)[0]
    return out.select("owner", "kind", F.sha2("text", 256).alias("sha"), F.col("artifact_hash").isNotNull().alias("artifact"), "replaced")


def marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with the marker of their route; every third without a head."""
    text = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<head>"), F.lit(""))).otherwise(F.col("html"))
    return _table(spark, sf, "pages").select("page_id", F.sha2(references.with_marker(text, F.concat(F.lit('page:"'), "page_id")), 256).alias("sha"))


def rewrite_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf)[1].groupBy("code", "severity", "phase").agg(F.count(F.lit(1)).alias("n"))


def graph_privacy(spark: SparkSession, sf: str) -> DataFrame:
    """Records of eleven families with URLs, texts, headers and bodies that hold secrets; what is found in each."""
    k, p = F.col("page_id"), _table(spark, sf, "pages")
    url = F.concat(F.lit("https://g.test/?token=abc"), k)
    own = p.select(F.concat(F.lit("r-"), k).alias("id"), url.alias("original_url"), F.when(k % 2 == 0, "password=abcdefgh12345").otherwise("fine").alias("note"))
    headers = p.select(F.concat(F.lit("r-"), k).alias("id"), F.create_map(F.lit("Cookie"), F.lit("a"), F.lit("Referer"), url).alias("headers"), F.when(k % 3 == 0, F.concat(F.lit('{"password":"x'), k, F.lit('"}'))).alias("request_body"), F.lit("application/json").alias("content_type"), F.lit("sha256:x").alias("request_body_hash"))
    families = {n: own for n in ("missions", "targets", "bodies", "documents", "routes", "dependency_edges", "api_exchanges", "derived_artifacts", "diagnostics")} | {"responses": headers.drop("request_body", "content_type", "request_body_hash"), "requests": headers}
    clean, counts = artifacts.sanitized_graph(families)
    held = clean["requests"].agg(F.lit("requests").alias("family"), F.count_if(F.col("request_body_hash").isNull()).alias("without_hash"), F.max("request_body").alias("body"))
    return counts.join(held, "family", "left").select("family", "records", "redactions", "without_hash", "body")


def sensitive_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of seven names with up to nineteen characters of what events carry."""
    names = ("token", "Code", "key", "page", "session_id", "api-key", "ref")
    e = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (e % len(names) + 1).cast("int"))
    value = F.substring(F.concat("props", "props"), F.lit(1), (e % 20).cast("int"))
    return _table(spark, sf, "events").select("event_id", privacy.is_sensitive_parameter(name, value).alias("parameter"), privacy.is_sensitive_name(name).alias("name"))


def private_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Form fields of four sorts by page_id."""
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("page_id") % len(x) + 1).cast("int"))
    field = privacy.is_sensitive_field(pick("text", "PASSWORD", "email", None), pick("", "name", "off cc-number"), pick("q", "user_pin box", "shopping", "spinning", "csrf"), F.when(F.col("page_id") % 7 == 0, F.array(F.lit("data-private"))))
    return _table(spark, sf, "pages").select("page_id", field.alias("private"))


QUERIES = {f.__name__: f for f in (html_references, page_links, css_references, js_references, srcset_candidates, svg_references, resolved_references, reference_diagnostics, rewritten_html, secret_findings, redacted_texts, document_secrets, sanitized_headers, sanitized_urls, sanitized_bodies, sanitized_metadata, sanitized_requests, private_artifacts, rewritten_resources, marked_pages, rewrite_diagnostics, graph_privacy, private_fields, sensitive_parameters)}

# The detectors as RE2 takes them: no look-ahead, so a run with a figure is spelled out by the place of its first figure.
_RUN, _WORDS = "[A-Za-z0-9_~+/=-]", "[A-Za-z_~+/=-]"
_WITH_FIGURE = "|".join([rf"{_WORDS}{{{i}}}\\d{_RUN}{{{11 - i},}}" for i in range(12)] + [rf"{_WORDS}{{12,}}\\d{_RUN}*"])
_RE2 = (
    ("private-key", "high", r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    *[d for d in privacy.DETECTORS if d[0] in ("jwt-token", "authorization-token", "api-key")],
    ("generic-secret", "medium", rf"""(?i)(?:api[_-]?key|client[_-]?secret|credential|password|refresh[_-]?token|secret|session(?:id)?|token)['"]?\s*[:=]\s*(?:'[A-Za-z0-9_\-.~+/=]{{12,}}'|"[A-Za-z0-9_\-.~+/=]{{12,}}"|{_WITH_FIGURE.replace(chr(92) * 2, chr(92))})"""),
)


def _scan_sql(source: str, text: str) -> str:
    """t0 .. t5: texts after each detector, with what it found as m1 .. m5."""
    steps = [f"t0 AS (SELECT *, {text} AS t FROM {source})"]
    for n, (_, _, pattern) in enumerate(_RE2, 1):
        quoted = pattern.replace("'", "''")
        steps.append(f"t{n} AS MATERIALIZED (SELECT * EXCLUDE (t), regexp_extract_all(t, '{quoted}') AS m{n}, regexp_replace(t, '{quoted}', '[REDACTED]', 'g') AS t FROM t{n - 1})")
    return ", ".join(steps)


_BUCKET = "CASE WHEN length(m) < 8 THEN '<8' WHEN length(m) < 16 THEN '8-15' WHEN length(m) < 32 THEN '16-31' WHEN length(m) < 64 THEN '32-63' ELSE '64+' END"
_SECRET = "CASE doc_id % 5 WHEN 0 THEN ' Bearer abcdef' || (doc_id + 10000000) WHEN 1 THEN ' AKIAABCDEFGH' || lpad(CAST(doc_id AS VARCHAR), 8, '0') WHEN 2 THEN ' eyJabcdefgh.eyJabcdefgh.sig' || (doc_id + 10000000) WHEN 3 THEN ' password=abcdefgh1' || (doc_id + 10000) ELSE '' END"
_PLANTED = _scan_sql("documents", f"text || ' note' || {_SECRET} || ' end.'")
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{k}' AS confidence, unnest(m{n}) AS m FROM t5" for n, (c, k, _) in enumerate(_RE2, 1))
_ENC = "array_to_string([CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END FOR c IN string_split({0}, '')], '')"
_LINKS = """l0 AS (SELECT CAST(page_id AS VARCHAR) AS owner, page_id, url AS base_url, html, string_split(html, '<a href="') AS parts FROM pages),
links AS (SELECT *, split_part(parts[i + 1], '"', 1) AS raw, CAST(list_sum([length(x) FOR x IN parts[1:i]]) + 9 * i AS INTEGER) AS start FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM l0))"""
_HOME = "regexp_extract(base_url, '^([a-z]+://[^/?#]*)', 1)"


def _values(rows: list[tuple]) -> str:
    """A row of each page for each of these rows of expressions."""
    return " UNION ALL ".join(f"SELECT CAST(page_id AS VARCHAR) AS owner, {', '.join(row)} FROM pages" for row in rows)


ORACLE_SQL = {
    "page_links": "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS raw_value FROM pages",
    "html_references":
        f"WITH {_LINKS} "
        f"SELECT owner, CAST(i - 1 AS INTEGER) AS n, 'svg-href' AS syntax, 'navigation' AS role, raw AS raw_value, {_ENC.format(_HOME + ' || raw')} AS resolved_url, 'preserve-navigation' AS policy, start, CAST(start + length(raw) AS INTEGER) AS end "
        f"FROM links",
    "css_references": _values([("0 AS n", "'css-import' AS syntax", "'css-import' AS role", "'base' || page_id || '.css' AS raw_value"), ("1", "'css-url'", "'image'", "'i' || page_id || '.png'"), ("2", "'css-url'", "'font'", "'f.woff2'"), ("3", "'css-image-set'", "'image'", "'s.png'"), ("4", "'css-image-set'", "'image'", "'t.png'")]),
    "js_references": _values([("0 AS n", "'javascript-import-from' AS syntax", "'module' AS role", "'./m' || page_id || '.js' AS raw_value", "'block-unresolved-executable' AS policy"), ("1", "'javascript-dynamic-import'", "'module'", "'/d.js'", "'block-unresolved-executable'"), ("2", "'javascript-src-assignment'", "'script'", "'/e.js'", "'block-unresolved-executable'"), ("3", "'javascript-setattribute-src'", "'script'", "'/f.js'", "'block-unresolved-executable'"), ("4", "'javascript-static-asset-url'", "'image'", "'https://h.test/i.png'", "'localize-if-captured'")]),
    "svg_references": _values([("0 AS n", "'svg-xlink:href' AS syntax", "'resource' AS role", "'#g' || page_id AS raw_value"), ("1", "'svg-href'", "'image'", "'i.png'"), ("2", "'svg-fill'", "'image'", "'p.svg#a'")]),
    "srcset_candidates": "SELECT CAST(page_id AS VARCHAR) AS owner, v.n, CASE v.n WHEN 0 THEN 'a' || page_id || '.png' WHEN 1 THEN 'data:image/png;base64,AA==' ELSE 'b' || page_id || '.png' END AS raw_value FROM pages, (VALUES (0), (1), (2)) v(n)",
    "resolved_references": f"""WITH {_LINKS} SELECT owner, CAST(i + 2 AS INTEGER) AS n, raw AS raw_value, 'preserved' AS disposition, 'navigation' AS reason, raw AS replacement FROM links
UNION ALL SELECT CAST(page_id AS VARCHAR), 0, '/lost.css', 'blocked', 'unresolved-executable', 'data:text/css,' FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 2, '/s.js', 'blocked', 'unresolved-executable', 'data:text/javascript,export%20{{}}' FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 1, '/i' || page_id || '.png', CASE WHEN page_id % 2 = 0 THEN 'localized' ELSE 'blocked' END, CASE WHEN page_id % 2 = 0 THEN 'captured' ELSE 'unresolved-subresource' END, CASE WHEN page_id % 2 = 0 THEN '/assets/i' || page_id || '.png' ELSE 'data:,' END FROM pages""",
    "reference_diagnostics": "SELECT 'unresolved-executable' AS code, 'error' AS severity, 2 * count(*) AS n FROM pages UNION ALL SELECT 'unresolved-subresource', 'warning', count(*) FROM pages WHERE page_id % 2 = 1",
    "rewritten_html": """SELECT CAST(page_id AS VARCHAR) AS owner, '<link rel="stylesheet" href="data:text/css,"><img src="' || CASE WHEN page_id % 2 = 0 THEN '/assets/i' || page_id || '.png' ELSE 'data:,' END || '"><script src="data:text/javascript,export%20{}"></script>' || regexp_replace(html, '(<head>)', '\\1<script src="/offline.js"></script>') AS text, 3 AS replaced FROM pages""",
    "secret_findings": f"WITH {_PLANTED}, f AS ({_FOUND}) SELECT doc_id, category, confidence, '<redacted:' || {_BUCKET} || ' chars>' AS masked FROM f",
    "redacted_texts": f"WITH {_PLANTED} SELECT doc_id, t AS text FROM t5",
    "document_secrets": f"WITH {_scan_sql('documents', 'text')}, f AS ({_FOUND}) SELECT doc_id, category, count(*) AS n FROM f GROUP BY 1, 2",
    "sanitized_headers": with_(REQUESTS,
        "SELECT event_id, '[REDACTED]' AS cookie, '[REDACTED]' AS session, content_type AS accept, '[REDACTED]' AS note, regexp_replace(normalized_url, '^([a-z]+://)', '\\1%5BREDACTED%5D:%5BREDACTED%5D@') || "
        "CASE WHEN contains(normalized_url, '?') THEN '&' ELSE '?' END || 'token=%5BREDACTED%5D' AS referer, coalesce(request_body, '') AS posted, 6 AS found FROM requests"),
    "sanitized_urls":
        "WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS plain FROM pages) SELECT page_id, "
        "CASE WHEN page_id % 3 = 0 THEN regexp_replace(plain, '^([a-z]+://)', '\\1%5BREDACTED%5D:%5BREDACTED%5D@') ELSE plain END || "
        "CASE WHEN contains(plain, '?') THEN '&' ELSE '?' END || 'token=%5BREDACTED%5D&code=x' || CASE WHEN page_id % 4 = 0 THEN '' ELSE '#top' END AS url, 1 + "
        "CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS found FROM p",
    "sanitized_bodies":
        "WITH p AS (SELECT *, regexp_replace(url, '#.*$', '') AS plain FROM pages) "
        "SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN '{\"user\":{\"password\":\"[REDACTED]\",\"name\":\"' || plain || '\"},\"list\":[1,\"[REDACTED]\"]}' WHEN page_id % 3 = 1 THEN 'name=' || regexp_replace(plain, '[^a-z]', '', 'g') || '&api_key=%5BREDACTED%5D' WHEN page_id % 2 = 0 THEN html ELSE '[REDACTED]' END) AS body, page_id % 3 < 2 OR page_id % 2 = 0 AS safe, "
        "CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN 1 WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS found FROM p",
    "sanitized_metadata": "SELECT event_id, '[REDACTED]' AS session, 'https://%5BREDACTED%5D:%5BREDACTED%5D@h.test/?key=%5BREDACTED%5D' AS at, 4 AS found FROM events",
    "sanitized_requests": with_(REQUESTS, "SELECT id, original_url, CAST(json(request_body) AS VARCHAR) AS request_body, request_body_hash, 0 AS redactions FROM requests"),
    "private_artifacts":
        f"WITH {_scan_sql('documents', 'text')} "
        f"SELECT doc_id, text || ' note end. see https://a.test/?token=%5BREDACTED%5D' AS text, CAST(NULL AS VARCHAR) AS content_hash, true AS sanitized FROM t5 "
        f"WHERE doc_id % 5 = 4 AND len(m1) + len(m2) + len(m3) + len(m4) + len(m5) = 0",
    "marked_pages": """WITH m AS (SELECT page_id, html, '<script>document.documentElement.dataset.validationMarker="page:\\"' || page_id || '";</script>' AS s FROM pages) SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN s || replace(html, '<head>', '') ELSE replace(html, '<head>', '<head>' || s) END) AS sha FROM m""",
    "rewrite_diagnostics": f"""SELECT 'resource-parser-html-rewrite-failed' AS code, 'warning' AS severity, 'resource-rewrite' AS phase, count(*) AS n FROM pages WHERE page_id % 5 = 0 AND {_BROKEN} UNION ALL SELECT 'resource-parser-rewrite-failed', 'warning', 'resource-rewrite', count(*) FROM pages WHERE page_id % 5 IN (1, 2) AND {_BROKEN}
UNION ALL SELECT 'unresolved-subresource', 'warning', 'resource-rewrite', count(*) FROM pages WHERE page_id % 5 IN (0, 1) AND NOT ({_BROKEN}) UNION ALL SELECT 'unresolved-executable', 'error', 'resource-rewrite', count(*) FROM pages WHERE page_id % 5 = 2 AND NOT ({_BROKEN})""",
    "rewritten_resources": f"""WITH r AS (SELECT CAST(page_id AS VARCHAR) AS owner, page_id % 5 AS k, {_BROKEN} AS broken, page_id % 10 = 0 AS route, html FROM pages),
t AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN broken THEN '<img src="/i.png">' || html || '<a href="' ELSE '<img src="data:,">' || html END
 WHEN 1 THEN CASE WHEN broken THEN '@import ''/known.css''; a{{b:url(/i.png)}} /* ' || html || ' ' ELSE '@import ''/assets/known.css''; a{{b:url(data:,)}} /* ' || html || ' */ ' END
 WHEN 2 THEN CASE WHEN broken THEN 'import "/m.js"; import "/known.css"; /* ' || html ELSE 'import "data:text/javascript,export%20{{}}"; import "/assets/known.css"; /* ' || html || ' */ ' END
 WHEN 3 THEN '{{"title":' || CAST(to_json({{'h': html}}) AS VARCHAR) || ',"buffers":[{{"uri":"/assets/known.css"}},{{"uri":"data:x"}}]}}' ELSE html END AS text FROM r)
SELECT owner, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'css' WHEN 2 THEN 'javascript' WHEN 3 THEN 'gltf' END AS kind, sha256(CASE WHEN k = 0 AND route THEN regexp_replace(text, '(<head>)', '\\1<script src=/b.js></script>') ELSE text END) AS sha, k IN (0, 3) OR (k IN (1, 2) AND NOT broken) AS artifact, CASE WHEN k = 3 THEN 1 WHEN broken OR k = 4 THEN 0 WHEN k = 0 THEN 1 ELSE 2 END AS replaced FROM t""",
    "graph_privacy":
        "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE page_id % 2 = 0) AS even, count(*) FILTER (WHERE page_id % 3 = 0) AS third "
        "FROM pages), f AS (SELECT unnest(['missions', 'targets', 'bodies', 'documents', 'routes', 'dependency_edges', 'api_exchanges', 'derived_artifacts', 'diagnostics', 'responses', 'requests']) AS family) "
        "SELECT family, n AS records, CASE family WHEN 'responses' THEN 2 * n + n WHEN 'requests' THEN 3 * n + third ELSE 2 * n + even END AS redactions, "
        "CASE WHEN family = 'requests' THEN third END AS without_hash, CASE WHEN family = 'requests' THEN '{\"password\":\"[REDACTED]\"}' END AS body FROM c, f",
    "sensitive_parameters": "SELECT event_id, CASE event_id % 7 WHEN 1 THEN event_id % 20 >= 12 WHEN 2 THEN event_id % 20 >= 12 ELSE event_id % 7 IN (0, 4, 5) END AS parameter, event_id % 7 IN (0, 4, 5) AS name FROM events",
    "private_fields": "SELECT page_id, page_id % 4 = 1 OR page_id % 3 = 2 OR page_id % 5 IN (1, 4) OR page_id % 7 = 0 AS private FROM pages",
}
