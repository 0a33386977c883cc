"""References of texts as rows: what tasks do with Arrow's batches.

Without pandas, which would be more than a third of a worker's memory; ``pyarrow.array`` loads it, so arrays are made of their buffers here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from . import markup, whatwg

#: What is read of each text.
TEXT = ("owner", "base_url", "text", "syntax")
#: A row for each reference.
ROW = "owner string, base_url string, n int, syntax string, role string, raw_value string, resolved_url string, normalized_url string, kind string, policy string, start int, end int, quote string, tag string, attribute string, fault string"
NAMES = [f.split()[0] for f in ROW.split(", ")]
_INTS = {f.split()[0] for f in ROW.split(", ") if f.endswith(" int")}

#: References that go back to Spark at once, and their characters, about: a text may have any number, and each may hold a whole file.
AT_ONCE, MOST = 5000, 4 << 20


def in_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (text for batch in batches for text in zip(*(batch.column(name).to_pylist() for name in TEXT), strict=True))
    for part in parts(texts):
        columns = zip(NAMES, zip(*part, strict=True), strict=True)
        yield pa.RecordBatch.from_arrays([ints(values) if name in _INTS else strings(values) for name, values in columns], NAMES)


def ints(values: Sequence[int]) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(np.array(values, "int32"))])


def strings(values: Sequence[str | None]) -> pa.Array:
    coded = [b"" if v is None else v.encode() for v in values]
    ends = np.cumsum([0, *map(len, coded)])
    if ends[-1] > np.iinfo("int32").max:
        raise OverflowError(f"{len(values)} strings of {ends[-1]} bytes")
    there = pa.py_buffer(np.packbits([v is not None for v in values], bitorder="little"))
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends.astype("int32")), pa.py_buffer(b"".join(coded)), there)


def parts(texts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows of all texts in order, in parts that are bounded by their number and by their characters; a row that is larger ends its part."""
    part, size = [], 0
    for text in texts:
        for row in _rows(*text):
            part.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(part) >= AT_ONCE or size >= MOST:
                yield part
                part, size = [], 0
    if part:
        yield part


def _rows(owner: str, base: str, text: str | None, kind: str) -> Iterator[tuple]:
    try:
        found = list(markup.READERS[kind](text or ""))
    except ValueError as e:
        return iter([(owner, base, -1, kind, "", "", None, None, "", "", 0, 0, "", "", "", str(e))])
    return (_row(owner, base, n, r) for n, r in enumerate(found))


def _row(owner: str, base: str, n: int, r: markup.Reference) -> tuple:
    try:
        kind, url, normal = whatwg.reference(r.raw, base) or ("", None, None)
    except ValueError:
        kind, url, normal = "invalid", None, None
    return owner, base, n, r.syntax, r.role, r.raw, url, normal or None, kind, r.policy, r.start, r.end, r.quote, r.tag, r.attribute, None
