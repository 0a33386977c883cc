"""Files that glTF documents name: `uri` members of JSON at any depth."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _walk(value: object, seen: Callable[[str], str]) -> object:
    """The value with every uri replaced by what ``seen`` says for it."""
    if isinstance(value, dict):
        return {k: seen(v) if k == "uri" and isinstance(v, str) else _walk(v, seen) for k, v in value.items()}
    return [_walk(v, seen) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.ArrayType(T.StringType()))
def uris(texts: pd.Series) -> pd.Series:
    """The uris of each document in order; texts that aren't JSON name none."""

    def one(text: str | None) -> list[str]:
        found: list[str] = []
        try:
            _walk(json.loads(text or "null"), lambda uri: found.append(uri) or uri)
        except ValueError:
            return []
        return found

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def with_uris(texts: pd.Series, local: pd.Series) -> pd.Series:
    """The documents with uris as local (array of raw, to) says; texts that aren't JSON stay."""

    def one(text: str | None, changes: list | None) -> str | None:
        to = {c["raw"]: c["to"] for c in ([] if changes is None else changes)}
        try:
            return json.dumps(_walk(json.loads(text or ""), lambda uri: to.get(uri, uri)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return pd.Series([one(t, c) for t, c in zip(texts, local, strict=True)], dtype=object)
