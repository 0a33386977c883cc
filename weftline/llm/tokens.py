"""Whole texts to token ids with the tokenizers library, each distinct stretch of text encoded once per worker.

A text is cut only where byte-level BPE with the usual letter/number/other split always has a boundary, so the ids
of the stretches, one after another, are the ids of the text:

1. after a letter, before an ASCII character that is no letter;
2. after ASCII punctuation, before ASCII white space;
3. after a lone tab, line feed or carriage return, before a letter. Of longer runs of white space the split takes off the last
   character only if something follows, so a run must not be the end of a stretch.

Letters here are a-z, A-Z and the letters of U+00C0 to U+00FF; any other character never has a cut beside it unless a
rule names it, so texts in other scripts are merely cut less often.

The library takes added tokens (as <|endoftext|>) out of a text before anything else. No cut goes through one, and a stretch that holds
one goes to the library as it is; a row with an added token that minds its surroundings is one stretch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import Slice, SpanHasher

END_ID = 2
_ALPHA = np.zeros(256, bool)
_ALPHA[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b"\t\n\r")] = True
_PLAIN_ASCII = np.arange(256) < 0x80


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def places_of(content: bytes, blob: bytes) -> np.ndarray:
    """Where content begins in blob, overlaps included."""
    found, at = [], blob.find(content)
    while at >= 0:
        found.append(at)
        at = blob.find(content, at + 1)
    return np.array(found, np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = (), blob: bytes = b"", alone: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where stretches begin in the flat bytes (the same as blob) of some rows; empty rows have none.

    None begins inside what equals one of whole, nor in a row in which one of alone stands.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        lead = data[:-1] == 0xC3
        second = data[1:]
        pair = lead & (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        alpha = _ALPHA[data]
        ends_letter, begins_letter = alpha.copy(), alpha.copy()
        ends_letter[1:] |= pair
        begins_letter[:-1] |= pair
        inner = cut[1:n]
        inner |= ends_letter[:-1] & (_PLAIN_ASCII & ~_ALPHA)[second]
        inner |= _PUNCTUATION[data[:-1]] & _SPACE[second]
        lone = _BREAK[data[:-1]] & begins_letter[1:]
        lone[1:] &= ((data[:-2] > 0x20) & (data[:-2] < 0x7F)) | ends_letter[:-2]
        inner |= lone
        for content in whole:
            for at in places_of(content, blob):
                cut[at + 1 : at + len(content)] = False
        for content in alone:
            rows = np.unique(np.searchsorted(offsets, places_of(content, blob), "right") - 1)
            for a, b in zip(offsets[rows], offsets[rows + 1], strict=True):
                cut[a:b] = False
    cut[offsets[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes in the vocabulary of byte-level BPE."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes slices of rows; what it has encoded before it looks up by the hash of the bytes.

    The table has a fixed number of places and the pool of ids a size beyond which all is forgotten, so memory is bounded; a stretch that
    lost its place is encoded again. Frequent stretches are soon back, so a small table does.
    """

    #: Places of the table, a power of two, and ids in the pool (a slice of many new ones may need more, once).
    PLACES, POOL = 1 << 20, 1 << 22

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = tuple(t.content.encode() for t in added if t.content)
        self.alone = tuple(t.content.encode() for t in added if t.content and (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(self.PLACES, np.uint64)
        self.begin = np.zeros(self.PLACES, np.uint32)
        self.count = np.zeros(self.PLACES, np.uint16)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _new(self, stretch: bytes) -> list[int]:
        word = stretch[1:] if stretch[:1] == b" " else stretch
        if word.isalpha() and not any(content in stretch for content in self.added):  # bytes: ASCII letters only, so it is one unit of the split
            return [t.id for t in self.model.tokenize(stretch.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(stretch.decode("utf-8"), add_special_tokens=False).ids

    def encode(self, rows: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row's followed by END_ID, and where each row's begin (rows + 1)."""
        n_rows = len(rows)
        blob = rows.data.tobytes()
        starts = stretches(rows.data, rows.offsets, self.added, blob, self.alone)
        if not len(starts):
            return np.full(n_rows, END_ID, np.uint32), np.arange(n_rows + 1)
        ends = np.append(starts[1:], len(rows.data))
        hashes = SpanHasher(rows.data).spans(starts, ends) | np.uint64(1)
        place = (hashes >> np.uint64(65 - self.PLACES.bit_length())).astype(np.int64)  # the highest bits
        begin, count = self.begin[place].astype(np.int64), self.count[place].astype(np.int64)
        missed = np.flatnonzero(self.keys[place] != hashes)
        if len(missed):
            new, first, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if self.used > self.POOL:
                self._forget()
                return self.encode(rows)
            ids = [self._new(blob[starts[i] : ends[i]]) for i in missed[first]]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            begins = self.used + np.cumsum(counts) - counts
            total = int(counts.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
            self.used += total
            begin[missed], count[missed] = begins[which], counts[which]
            short = counts < 1 << 16
            at = place[missed[first]][short]
            self.keys[at], self.begin[at], self.count[at] = new[short], begins[short], counts[short]
        upto = np.cumsum(count)
        flat = self.pool[np.repeat(begin - (upto - count), count) + np.arange(upto[-1])]
        row_ends = np.concatenate([[0], upto])[np.searchsorted(starts, rows.offsets[1:], "left")]
        flat = np.insert(flat, row_ends, END_ID)
        return flat, np.concatenate([[0], row_ends + np.arange(1, n_rows + 1)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(array: pa.Array, path: str) -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
    from .shared import slices

    for rows in slices(array):
        yield rows, *encoder(path).encode(rows)
