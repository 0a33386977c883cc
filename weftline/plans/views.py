"""The mapping of sources/capture.py in SQL: common table expressions that oracle queries begin with."""

NORMAL = "regexp_replace({0}, '#.*$', '')"
METHOD = "CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'signup' THEN 'PUT' WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'HEAD' ELSE 'GET' END"
PROVENANCE = "CASE WHEN event_id % 7 = 0 THEN 'refetched' WHEN event_id % 11 = 0 THEN 'derived' ELSE 'observed' END"

REQUESTS = f"""
q0 AS (SELECT e.*, p.url, p.html, {METHOD} AS method FROM events e JOIN pages p ON e.user_id = p.page_id),
requests AS (SELECT 'request-' || (event_id + 1) AS id, event_id + 1 AS sequence, event_id, user_id, user_id % 20 AS mission_id, ts, event_type, method,
  url AS original_url, {NORMAL.format("url")} AS normalized_url, CASE WHEN method = 'POST' THEN props END AS request_body,
  CASE WHEN method = 'POST' THEN 'sha256:' || sha256(props) END AS request_body_hash, CASE WHEN method = 'POST' THEN 'application/json' ELSE '' END AS content_type, {PROVENANCE} AS provenance FROM q0)"""

RESPONSES = f"""{REQUESTS},
page_bodies AS (SELECT page_id, 'sha256:' || sha256(html) AS hash, CAST(strlen(html) AS BIGINT) AS bytes FROM pages),
responses AS (SELECT 'response-' || r.sequence AS id, r.id AS request_id, r.sequence, r.event_id, r.user_id, r.mission_id, r.ts, r.event_type, r.method, r.normalized_url, r.request_body, r.request_body_hash, r.content_type, r.provenance,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
  CASE WHEN event_type = 'view' THEN 'Document' WHEN event_type IN ('click', 'error') THEN 'XHR' ELSE 'Fetch' END AS resource_type,
  CASE WHEN method NOT IN ('HEAD', 'PUT') THEN 'body-' || hash END AS body_id, CASE WHEN method NOT IN ('HEAD', 'PUT') THEN hash END AS content_hash, CASE WHEN method NOT IN ('HEAD', 'PUT') THEN bytes END AS size,
  CASE WHEN method NOT IN ('HEAD', 'PUT') THEN 'stored' ELSE 'not-applicable' END AS body_state, 'text/html' AS mime_type, event_id % 3 = 0 AS from_service_worker
  FROM requests r JOIN page_bodies b ON r.user_id = b.page_id),
exchanges AS (SELECT *, 'exchange-' || sequence AS exchange_id FROM responses WHERE event_type IN ('click', 'purchase', 'error', 'signup'))"""

REDIRECTS = f"""{REQUESTS},
ordered AS (SELECT *, lag(id) OVER w AS predecessor_id, lag(event_id) OVER w AS predecessor_event, lag(original_url) OVER w AS predecessor_url FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
redirects AS (SELECT * FROM ordered WHERE predecessor_event % 13 = 0)"""

ORIGIN = "regexp_extract({0}, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)"
PATHNAME = "CASE WHEN regexp_extract({0}, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END"
SEARCH = "CASE WHEN regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1) END"
TRIMMED = "CASE WHEN length({0}) > 1 THEN regexp_replace({0}, '/+$', '') ELSE {0} END"


def pathname(url: str) -> str:
    return f"({PATHNAME.format(url)})"


def search(url: str) -> str:
    return f"({SEARCH.format(url)})"


def origin(url: str) -> str:
    return ORIGIN.format(url)


def path_key(url: str) -> str:
    return f"({TRIMMED.format(pathname(url))} || {search(url)})"


def normal(url: str) -> str:
    return NORMAL.format(url)


def with_(views: str, query: str) -> str:
    return f"WITH RECURSIVE {views.strip()} {query}"


SHORT_HASH = "lower(to_base(list_reduce(list_prepend(5381::BIGINT, [ord(c)::BIGINT FOR c IN string_split({0}, '')]), lambda h, c: xor((h * 33) & 4294967295, c)), 36))"
EXTENSION = """CASE WHEN regexp_matches({0}, '(java|ecma)script') THEN '.js' ELSE coalesce(MAP {{'text/html': '.html', 'text/css': '.css', 'application/wasm': '.wasm', 'application/manifest+json': '.webmanifest', 'application/json': '.json', 'image/svg+xml': '.svg', 'image/png': '.png', 'image/jpeg': '.jpg', 'image/webp': '.webp', 'image/avif': '.avif', 'image/gif': '.gif', 'font/woff2': '.woff2', 'font/woff': '.woff'}}[{0}], '') END"""
