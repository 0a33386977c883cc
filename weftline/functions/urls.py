"""URL expressions for http(s) URLs that are already normal: lower-case host, no default port, no dot segments.

What is not normal goes through ``whatwg.normalized`` first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import whatwg


def normalized(url: Column) -> Column:
    """Without fragment."""
    return F.regexp_replace(url, "#.*$", "")


@F.pandas_udf(T.StringType())
def canonical(found: pd.Series) -> pd.Series:
    """Any http(s) URL in its normal form without fragment: case of scheme and host, default ports, dot segments and escapes; null for what is no URL."""

    def one(url: str | None) -> str | None:
        try:
            return None if url is None else whatwg.normalized(url)
        except ValueError:
            return None

    return pd.Series([one(u) for u in found], dtype=object)


def is_http(url: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(url), F.lit("^https?://.")), F.lit(False))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def pathname(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def search(url: Column) -> Column:
    """The query with its question mark; an empty query is nothing."""
    found = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(found == "?", "").otherwise(found)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "(#.+)$", 1)


def trimmed_path(url: Column) -> Column:
    path = pathname(url)
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)


def path_key(url: Column) -> Column:
    """Path without slashes at the end, and query: what a request is known by whatever its host."""
    return F.concat(trimmed_path(url), search(url))


def validation_key(url: Column) -> Column:
    """path_key with the fragment."""
    return F.concat(path_key(url), fragment(url))


def resource_key(url: Column) -> Column:
    """Path as it is, and query."""
    return F.concat(pathname(url), search(url))


def route_key(url: Column, transition: Column) -> Column:
    return F.concat(transition, F.lit(":"), F.when(transition == "history", url).otherwise(normalized(url)))


@F.pandas_udf(T.StringType())
def _parsed(raw: pd.Series, base: pd.Series) -> pd.Series:
    """What the parser makes of a reference beside its base; null for what is no URL."""

    def one(value: str | None, beside: str | None) -> str | None:
        try:
            return None if value is None else whatwg.parsed(value, beside)
        except ValueError:
            return None

    return pd.Series([one(v, b) for v, b in zip(raw, base, strict=True)], dtype=object)


#: Characters that stay as they are anywhere in a URL, a host that is normal, and segments that mean folders.
_PLAIN, _HOST = r"[A-Za-z0-9._~!$&()*+,;=:@%/-]", "[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"
_DOTS = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|[?#]|$)"


def resolved(raw: Column, base: Column) -> Column:
    """The URL that a reference means beside its base, relative ones and dot segments included; null for what is no URL.

    Normal references beside normal bases are put together by expressions; only others go to the parser in Python: ports, credentials, dot segments, odd characters.
    """
    raw, base = (F.col(x) if isinstance(x, str) else x for x in (raw, base))
    rest = rf"(?:{_PLAIN}*)(?:\?(?:{_PLAIN}|\?)*)?(?:#(?:{_PLAIN}|\?)*)?"
    normal_base = F.rlike(base, F.lit(rf"^https?://{_HOST}(?:/{rest})?$")) & ~F.rlike(base, F.lit(_DOTS))
    plain = F.rlike(raw, F.lit(f"^{rest}$")) & ~F.rlike(raw, F.lit(_DOTS))
    absolute = F.rlike(raw, F.lit(rf"^https?://{_HOST}(?:[/?#]|$)"))
    named = F.rlike(raw, F.lit("^[^/?#]*:"))
    bare = F.regexp_replace(base, "[?#].*$", "")
    without_fragment = F.regexp_replace(base, "#.*$", "")
    slashed = lambda url: F.regexp_replace(url, r"^(https?://[^/?#]+)(?=[?#]|$)", "$1/")
    folder = F.regexp_extract(slashed(bare), "^(.*/)", 1)
    made = (
        F.when(absolute, slashed(raw))
        .when(F.startswith(raw, F.lit("/")) & ~F.startswith(raw, F.lit("//")), F.concat(origin(base), raw))
        .when(F.startswith(raw, F.lit("?")), F.concat(slashed(bare), raw))
        .when(F.startswith(raw, F.lit("#")), F.concat(slashed(without_fragment), raw))
        .when((raw != "") & ~named & ~F.startswith(raw, F.lit("/")), F.concat(folder, raw))
    )
    made = F.when(F.coalesce(normal_base & plain, F.lit(False)), F.regexp_replace(F.regexp_replace(made, r"^([^?#]*)\?(?=#|$)", "$1"), "#$", ""))
    return F.coalesce(made, _parsed(F.when(made.isNull(), raw), base))


def reference_kind(raw: Column) -> Column:
    """fragment, embedded, non-fetch or network; null for blank references."""
    scheme = F.lower(F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(raw.isNull() | F.rlike(raw, F.lit(r"^\s*$")), F.lit(None).cast("string"))
        .when(F.startswith(raw, F.lit("#")), "fragment")
        .when(scheme.isin("data", "blob"), "embedded")
        .when((scheme != "") & ~scheme.isin("http", "https"), "non-fetch")
        .otherwise("network")
    )


def base_scope(url: Column) -> Column:
    """Origin and folder: where relative references of a text resolve alike."""
    return F.concat(origin(url), F.regexp_extract(pathname(url), "^(.*/)", 1))
