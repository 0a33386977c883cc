"""The library in SQL: table functions for the references of texts, to be used with LATERAL, and functions that take secrets out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import markup, privacy, urls

_ROWS = "n int, syntax string, role string, raw string, policy string, tag string, start int, end int"


def _table_function(found: Callable[[str], Iterator[markup.Reference]]) -> type:
    class References:
        """A row for each reference of a text, in order; none of a null one."""

        def eval(self, text: str) -> Iterator[tuple]:
            for n, r in enumerate(found(text) if text else ()):
                yield n, r.syntax, r.role, r.raw, r.policy or markup.policy_for(r.role), r.tag, r.start, r.end

    return References


#: name: what it finds in a text.
TABLE_FUNCTIONS = {"html_references": markup.html_references, "svg_references": lambda text: markup.html_references(text, svg=True), "css_references": markup.css_references, "js_references": markup.js_references, "srcset_candidates": markup.srcset_references}
FUNCTIONS = {
    "sanitized_headers": privacy.sanitized_headers, "sanitized_url": privacy.sanitized_url, "sanitized_text": privacy.sanitized_text, "sanitized_body": privacy.sanitized_body, "sanitized_metadata": privacy.sanitized_metadata,
    "canonical_url": urls.canonical,
}


def register(spark: SparkSession) -> None:
    """Makes TABLE_FUNCTIONS and FUNCTIONS known to the session's SQL by these names."""
    for name, found in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(_table_function(found), returnType=_ROWS))
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
