"""Secrets in text, headers, URLs and bodies.

Detection in text and headers is made of built-in expressions; URLs, JSON bodies and nested metadata are walked in tasks by small helpers.
Findings never hold the secret, only a bucket of its length.
"""

from __future__ import annotations

import contextlib
import functools
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import whatwg

REDACTED = "[REDACTED]"

# Detectors in the order in which they run, each on what the one before left; names and parameters that hold secrets.
DETECTORS = (
    ("private-key", "high", r"(?i)-----BEGIN ([A-Z ]*PRIVATE KEY)-----[\s\S]*?-----END \1-----"),
    ("jwt-token", "high", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_.+/=-]{8,}\b"),
    ("authorization-token", "high", r"(?i)\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}"),
    ("api-key", "high", r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{16,}|sk-(?:proj-)?[A-Za-z0-9_-]{20,}|(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{16,})\b"),
    ("generic-secret", "medium", r"""(?i)(?:api[_-]?key|client[_-]?secret|credential|password|refresh[_-]?token|secret|session(?:id)?|token)['"]?\s*[:=]\s*(?:(['"])[A-Za-z0-9_\-.~+/=]{12,}\1|(?=[A-Za-z0-9_~+/=-]{12,})(?=[A-Za-z0-9_~+/=-]*\d)[A-Za-z0-9_~+/=-]{12,})"""),
)
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "apikey", "api-key", "token")
SENSITIVE_NAMES = r"(?:^|[_\-.])(access[_-]?token|auth|authorization|api[_-]?key|client[_-]?secret|credential|csrf|cvv|cvc|password|passwd|passcode|pin|refresh[_-]?token|secret|session|sessionid|token|xsrf)(?:$|[_\-.])"
SENSITIVE_PARAMETERS = ("token", "access_token", "id_token", "refresh_token", "auth", "authorization", "key", "api_key", "apikey", "secret", "password", "passwd", "pwd", "session", "sessionid", "code", "client_secret", "csrf", "xsrf")
PRIVATE_FIELD_TYPES = ("password", "file", "hidden")
PRIVATE_AUTOCOMPLETE = r"(?:^|\s)(?:cc-|current-password|new-password|one-time-code|webauthn)"
PRIVATE_FIELD_NAMES = r"(?i)(?:^|[_\-.\s])(?:access[_-]?token|api[_-]?key|auth|card(?:holder|number)?|client[_-]?secret|credential|csrf|cvc|cvv|password|passcode|pin|refresh[_-]?token|secret|session(?:id)?|token|xsrf)(?:$|[_\-.\s])"
PRIVATE_ATTRIBUTES = ("data-private", "data-sensitive")
URL_CATEGORIES = ("url-parameter", "url-credential", "url-fragment")


def length_bucket(n: Column) -> Column:
    return F.when(n < 8, "<8").when(n < 16, "8-15").when(n < 32, "16-31").when(n < 64, "32-63").otherwise("64+")


def is_sensitive_name(name: Column) -> Column:
    return F.rlike(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(SENSITIVE_NAMES))


def is_sensitive_parameter(name: Column, value: Column) -> Column:
    """code and key are harmless where their value is short."""
    own = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    short = own.isin("code", "key") & (F.length(F.coalesce(value, F.lit(""))) < 12)
    return ~short & (own.isin(*SENSITIVE_PARAMETERS) | is_sensitive_name(own))


#: What a text must hold, lowered, for a detector to be worth running; detectors are slow and most texts hold none of these.
_HINTS = (("private key-----",), ("eyj",), ("bearer", "basic"), ("akia", "gh", "xox", "sk-", "sk_", "pk_"), ("key", "secret", "credential", "password", "token", "session"))


def _scanned(text: Column, location: Column) -> Column:
    """(text, found): what each detector leaves of what the one before left, and all that they found; each step is made once."""
    low = F.lower(text)
    none = F.array().cast("array<struct<category:string,location:string,confidence:string,masked:string>>")
    state = F.struct(text.alias("text"), none.alias("found"))
    for (category, confidence, pattern), hints in zip(DETECTORS, _HINTS, strict=True):
        hinted = functools.reduce(lambda x, y: x | y, [F.contains(low, F.lit(h)) for h in hints])
        state = F.get(F.transform(F.array(state), _step(category, confidence, pattern, hinted, location)), F.lit(0))
    return state


def _step(category: str, confidence: str, pattern: str, hinted: Column, location: Column) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), 0), _finder(category, confidence, location))
        after = F.struct(F.regexp_replace(s["text"], pattern, REDACTED).alias("text"), F.concat(s["found"], matches).alias("found"))
        return F.when(hinted, after).otherwise(s)

    return step


def redacted(text: Column) -> Column:
    """Text with what the detectors find replaced."""
    return _scanned(text, F.lit(""))["text"]


def findings(text: Column, location: Column) -> Column:
    """Array of (category, location, confidence, masked): what each detector finds in what the one before left."""
    return F.coalesce(_scanned(text, location)["found"], F.array().cast("array<struct<category:string,location:string,confidence:string,masked:string>>"))


def _finder(category: str, confidence: str, location: Column) -> Callable[[Column], Column]:
    return lambda match: _finding_column(category, confidence, location, match)


def _finding_column(category: str, confidence: str, location: Column, match: Column) -> Column:
    masked = F.concat(F.lit("<redacted:"), length_bucket(F.length(match)), F.lit(" chars>"))
    return F.struct(F.lit(category).alias("category"), location.alias("location"), F.lit(confidence).alias("confidence"), masked.alias("masked"))


def is_sensitive_field(kind: Column, autocomplete: Column, names: Column, attributes: Column) -> Column:
    """Whether a form field is private: by its type, its autocomplete, its names (name, id, label, joined by blanks) or a marking attribute (array of names)."""
    said = F.lower(F.coalesce(autocomplete, F.lit("")))
    return (
        F.lower(F.coalesce(kind, F.lit(""))).isin(*PRIVATE_FIELD_TYPES) | F.rlike(said, F.lit(PRIVATE_AUTOCOMPLETE)) | F.rlike(F.coalesce(names, F.lit("")), F.lit(PRIVATE_FIELD_NAMES))
        | F.arrays_overlap(F.coalesce(attributes, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in PRIVATE_ATTRIBUTES]))
    )


# Helpers of tasks ------------------------------------------------------------------------------------------------

_PATTERNS = [(c, k, re.compile(p, re.A)) for c, k, p in DETECTORS]
_NAMES = re.compile(SENSITIVE_NAMES)
_IN_TEXT = re.compile(r"https?://[^\s<>\"']+", re.I)
_PARAMETER = re.compile(r"([?&#])([^=&#\s]+)=([^&#\s]*)")
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:([^/?#@]*)@)?([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$")
_WEB = re.compile(r"https?://", re.I)
_SECRET_FRAGMENT = re.compile(r"(?:access_token|id_token|token|code|secret|session)=", re.I)

Found = list[tuple[str, str, str, str]]


def _finding(category: str, location: str, confidence: str, value: object) -> tuple[str, str, str, str]:
    n = len("" if value is None else str(value))
    bucket = next((name for most, name in ((8, "<8"), (16, "8-15"), (32, "16-31"), (64, "32-63")) if n < most), "64+")
    return category, location, confidence, f"<redacted:{bucket} chars>"


@functools.lru_cache(maxsize=10_000)
def _sensitive_name(name: str) -> bool:
    return bool(_NAMES.search(name.strip().lower()))


def _sensitive_parameter(name: str, value: str) -> bool:
    own = name.strip().lower()
    return not (own in ("code", "key") and len(value) < 12) and (own in SENSITIVE_PARAMETERS or _sensitive_name(own))


def _scan(text: str, location: str, found: Found) -> str:
    low = text.lower()
    for (category, confidence, pattern), hints in zip(_PATTERNS, _HINTS, strict=True):
        for hint in hints:
            if hint in low:
                break
        else:
            continue
        if matches := [m[0] for m in pattern.finditer(text)]:
            found += [_finding(category, location, confidence, m) for m in matches]
            text = pattern.sub(REDACTED, text)
    return text


def clean_url(url: str, location: str, found: Found) -> str:
    """A URL without credentials, secret parameters and secret fragments; of what is no URL, parameters and detectors' finds are replaced."""
    with contextlib.suppress(ValueError):
        url = whatwg.parsed(url) if _WEB.match(url or "") else url
    m = _URL.match(url or "")
    if not m:
        def one(p: re.Match) -> str:
            if not _sensitive_parameter(p[2], p[3]):
                return p[0]
            found.append(_finding("url-parameter", f"{location}.query.{p[2]}", "high", p[3]))
            return f"{p[1]}{p[2]}={REDACTED}"

        return _scan(_PARAMETER.sub(one, url or ""), location, found)
    scheme, user, host, path, query, fragment = m.groups()
    if user:
        name, _, password = user.partition(":")
        for part, value in (("username", name), ("password", password)):
            if value:
                found.append(_finding("url-credential", f"{location}.{part}", "high", value))
        user = "%5BREDACTED%5D" * bool(name) + ":%5BREDACTED%5D" * bool(password)
    pairs = parse_qsl((query or "")[1:], keep_blank_values=True)
    secret = [(k, v) for k, v in pairs if _sensitive_parameter(k, v)]
    if secret:
        found += [_finding("url-parameter", f"{location}.query.{k}", "high", v) for k, v in secret]
        names, out, seen = {k for k, _ in secret}, [], set()
        for k, v in pairs:  # the first of a name takes the new value, later ones go
            if k not in names:
                out.append((k, v))
            elif k not in seen:
                out.append((k, REDACTED))
                seen.add(k)
        query = "?" + urlencode(out)
    if fragment and _SECRET_FRAGMENT.search(fragment):
        found.append(_finding("url-fragment", f"{location}.fragment", "high", fragment))
        fragment = ""
    return f"{scheme}{f'{user}@' if user else ''}{host}{path or '/'}{query or ''}{fragment or ''}"


def clean_text(text: str, location: str, found: Found) -> str:
    """URLs in a text first, then the detectors."""
    text = text or ""
    if "://" in text:
        text = _IN_TEXT.sub(lambda m: clean_url(m[0], f"{location}.url", found), text)
    return _scan(text, location, found)


@functools.lru_cache(maxsize=1000)
def _clean_value(text: str, location: str) -> tuple[str, Found]:
    found: Found = []
    return clean_text(text, location, found), found


def clean_headers(headers: dict[str, str], location: str, found: Found) -> dict[str, str]:
    """Headers whose sensitive values are replaced whole, and the others as any text."""
    out = {}
    for name, value in headers.items():
        if name.lower() in SENSITIVE_HEADERS or _sensitive_name(name):
            found.append(_finding("header-secret", f"{location}.{name}", "high", value))
            out[name] = REDACTED
        else:
            out[name], own = _clean_value("" if value is None else value, f"{location}.{name}")
            found += own
    return out


def _clean_json(value: object, location: str, found: Found, *, urls: bool = False, fields: str = "body-field") -> object:
    if isinstance(value, list):
        return [_clean_json(v, f"{location}[{i}]", found, urls=urls, fields=fields) for i, v in enumerate(value)]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if _sensitive_name(k) and not (urls and v in (None, "")):
                found.append(_finding(fields, f"{location}.{k}", "high", v))
                out[k] = REDACTED
            else:
                out[k] = _clean_json(v, f"{location}.{k}", found, urls=urls, fields=fields)
        return out
    if isinstance(value, str):
        if urls and re.match(r"[a-z][a-z0-9+.\-]*://", value, re.I):
            return clean_url(value, location, found)
        return clean_text(value, location, found)
    return value


def clean_body(body: str | None, content_type: str | None, location: str, found: Found) -> tuple[str | None, bool]:
    """(body, safe): JSON and forms field by field; of anything else all or nothing."""
    if not body:
        return body, True
    kind = (content_type or "").split(";", 1)[0].strip().lower()
    if kind == "application/json" or body.strip()[:1] in ("{", "["):
        try:
            return json.dumps(_clean_json(json.loads(body), location, found), separators=(",", ":"), ensure_ascii=False), True
        except ValueError:
            pass
    if kind == "application/x-www-form-urlencoded":
        pairs = parse_qsl(body, keep_blank_values=True)
        for k, v in pairs:
            if _sensitive_name(k):
                found.append(_finding("body-field", f"{location}.{k}", "high", v))
        return urlencode([(k, REDACTED if _sensitive_name(k) else v) for k, v in pairs]), True
    own: Found = []
    _scan(body, location, own)
    found += own
    return (REDACTED, False) if own else (body, True)


_FINDINGS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("category", "location", "confidence", "masked")]))


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()] + [T.StructField("findings", _FINDINGS)])


def _url_row(url: str | None) -> tuple:
    found: Found = []
    return (None if url is None else clean_url(url, "url", found)), found


def _text_row(text: str | None) -> tuple:
    found: Found = []
    return (None if text is None else clean_text(text, "text", found)), found


def _body_row(body: str | None, kind: str | None) -> tuple:
    found: Found = []
    cleaned, safe = clean_body(body, kind, "request.body", found)
    return cleaned, safe, found


def _metadata_row(text: str | None) -> tuple:
    found: Found = []
    try:
        return (None if text is None else json.dumps(_clean_json(json.loads(text), "metadata", found, urls=True, fields="metadata-field"), separators=(",", ":"), ensure_ascii=False)), found
    except ValueError:
        return clean_text(text, "metadata", found), found


_ARROW_FINDINGS = pa.list_(pa.struct([(n, pa.string()) for n in ("category", "location", "confidence", "masked")]))


def _entries(maps: pa.Array) -> Iterator[dict[str, str] | None]:
    ends, pairs = maps.offsets.to_pylist(), list(zip(maps.keys.to_pylist(), maps.items.to_pylist(), strict=True))
    for n, there in enumerate(maps.is_valid().to_pylist()):
        yield dict(pairs[ends[n] : ends[n + 1]]) if there else None


@F.arrow_udf(_row(headers=T.MapType(T.StringType(), T.StringType())))
def sanitized_headers(headers: pa.Array) -> pa.Array:
    """(headers, findings) of header maps."""
    cleaned, findings = [], []
    for h in _entries(headers):
        found: Found = []
        cleaned.append(None if h is None else list(clean_headers(h, "headers", found).items()))
        findings.append(found)
    return pa.StructArray.from_arrays([pa.array(cleaned, pa.map_(pa.string(), pa.string())), pa.array(findings, _ARROW_FINDINGS)], ["headers", "findings"])


@F.pandas_udf(_row(url=T.StringType()))
def sanitized_url(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_url_row(u) for u in urls], columns=["url", "findings"])


@F.pandas_udf(_row(text=T.StringType()))
def sanitized_text(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_text_row(t) for t in texts], columns=["text", "findings"])


@F.pandas_udf(_row(body=T.StringType(), safe=T.BooleanType()))
def sanitized_body(bodies: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_body_row(b, k) for b, k in zip(bodies, kinds, strict=True)], columns=["body", "safe", "findings"])


@F.pandas_udf(_row(json=T.StringType()))
def sanitized_metadata(texts: pd.Series) -> pd.DataFrame:
    """JSON text of nested metadata, names and values; equal texts of a batch are cleaned once."""
    cleaned = {t: _metadata_row(t) for t in texts.unique()}
    return pd.DataFrame([cleaned[t] for t in texts], columns=["json", "findings"])


def runnable(mime: Column, cleaned: Column) -> Column:
    """Of a body's sanitized_text: whether it is risky, and whether replacing the finds is safe because all are in URLs."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    texty = (kind == "") | F.startswith(kind, F.lit("text/")) | F.rlike(kind, F.lit("json|javascript|xml|svg|x-www-form-urlencoded"))
    risky = texty & (F.size(cleaned["findings"]) > 0)
    return F.struct(risky.alias("risky"), (risky & F.forall(cleaned["findings"], lambda f: f["category"].isin(*URL_CATEGORIES))).alias("safe_to_sanitize"))
