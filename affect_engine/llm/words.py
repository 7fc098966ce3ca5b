"""Words, their hashes and their shingles for whole Arrow batches of text.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lowered.
Both rules act on single bytes, so they hold for UTF-8 as it is. Everything
works on the concatenated bytes of a batch: no loop over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` fixed 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(_STEP))


BYTE_VALUE = seeds(256, 1)
BYTE_VALUE[SPACE] = 0


def _powers(n: int) -> np.ndarray:
    base = np.full(max(n, 1), _BASE)
    base[0] = 1
    return np.multiply.accumulate(base)


class Words(NamedTuple):
    """Words of a slice: hash, document number, first byte and end byte."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each document, and of the end."""
        return np.concatenate(([0], np.cumsum(self.per_doc)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of concatenated texts; no word crosses a row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Words(none.astype(np.uint64), none, none, none, np.zeros(len(bounds) - 1, np.int64))
    solid = ~SPACE[data]
    row_start = np.zeros(n + 1, bool)
    row_start[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | row_start[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | row_start[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(bounds) - 1)
    if not len(start):
        return Words(none.astype(np.uint64), none, none, none, per_doc)
    gap = np.diff(np.append(start, n))
    place = np.arange(start[0], n, dtype=np.int64) - np.repeat(start, gap)
    value = BYTE_VALUE[LOWER[data[start[0] :]]] * _powers(int(gap.max()))[place]
    return Words(mix(np.add.reduceat(value, start - start[0])), doc, start, end, per_doc)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a document, and its first word.

    Documents with fewer words have none.
    """
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j, seed in enumerate(seeds(size, 1000)):
        total += (words.hash[j : j + n] ^ seed) * (seed | np.uint64(1))
    inside = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return mix(total[inside]), inside


def short_sequence(words: Words, doc: int) -> np.uint64:
    """One hash for the whole word sequence of a document below shingle size."""
    first = words.first
    total = np.uint64(0)
    run = words.hash[first[doc] : first[doc + 1]]
    with np.errstate(over="ignore"):
        for word, seed in zip(run, seeds(len(run), 2000), strict=True):
            total += (word ^ seed) * (seed | np.uint64(1))
    return mix(np.array([total ^ np.uint64(len(run) * 0x1234567)], np.uint64))[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most.

    A single longer text makes a slice of its own: texts are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            to = max(at + 1, min(to, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to
