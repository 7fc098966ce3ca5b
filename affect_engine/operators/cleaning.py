"""The normaliser on tables: plain words pass, the steps see only what they may change.

A plain word is letters in lower case, the first in any, with few kinds of marks after
them; slang and names are not plain. The steps change nothing in such a word but its
case and repeats, and never look past its first letter. So a text is cut
into stretches of plain words and stretches of others, each of these with the plain
word before it, to which marks may be drawn. The second kind is cleaned by the Columns
that clean a whole text, and a text is its stretches in order, a blank between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.text import clean_early, clean_text

#: Bytes of text that are cut together; a longer text is a slice of its own.
SLICE = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True

_LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100), *range(0x430, 0x450), 0x451]))
# "D:" and ":*" are emoticons.
_PLAIN = rf"^(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]?[{_LOWER}]+|[A-CE-ZÀ-ÖØ-ÞА-ЯЁ])(?::|[.,;!?]?[*#$%&]*)$"
_ENTITIES = {part.lower() for entry in (*vocab.NAMES, *vocab.RELIGIONS, *vocab.CITIES) for part in entry.split()}
_NOT_PLAIN = sorted({*vocab.SLANG, *_ENTITIES})

#: What a cleaner does to plain words.
_OF_PLAIN: dict[Callable, Callable[[Column], Column]] = {
    clean_early: lambda c: c,
    clean_text: lambda c: F.regexp_replace(F.lower(c), r"(.)\1{2,}", "$1$1"),
}


def _is_plain(words: pa.Array) -> np.ndarray:
    bare = pc.utf8_lower(pc.utf8_rtrim(words, ".,;:!?*#$%&"))
    # An address may begin inside a word.
    known = pc.or_(pc.is_in(bare, pa.array(_NOT_PLAIN, words.type)), pc.ends_with(bare, "www"))
    return pc.and_not(pc.match_substring_regex(words, _PLAIN), known).to_numpy(zero_copy_only=False)


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


def stretches(column: pa.Array) -> pa.ListArray:
    """Each text as a list of ``(text, plain)``, single blanks between words; null stays null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    texts = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    rows = bounds - bounds[0]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    of_row = np.searchsorted(start, rows)
    words = _strings(data[solid], np.concatenate(([0], np.cumsum(length)))).dictionary_encode()
    plain = _is_plain(words.dictionary)[words.indices.to_numpy()] if len(start) else np.zeros(0, bool)
    first = np.zeros(len(start) + 1, bool)
    first[of_row] = True
    # A plain word before one that isn't goes with it.
    plain[:-1] &= plain[1:] | first[1:-1]
    opens = first[:-1].copy()
    opens[1:] |= plain[1:] != plain[:-1]
    # Words that open no stretch take one blank along.
    inner = start[~opens] - 1
    flat, kept = data.copy(), solid
    flat[inner] = 0x20
    kept[inner] = True
    length += ~opens
    found = _strings(flat[kept], np.concatenate(([0], np.cumsum(length)))[np.append(np.flatnonzero(opens), len(length))])
    of_row = np.concatenate(([0], np.cumsum(opens)))[of_row].astype(np.int32)
    both = pa.StructArray.from_arrays([found.cast(pa.string()), pa.array(plain[opens])], names=["s", "plain"])
    return pa.ListArray.from_arrays(pa.array(of_row), both, mask=pa.array(null))


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def clean_texts(df: DataFrame, text: str, clean: Callable[[Column], Column] = clean_text) -> DataFrame:
    """``df`` with ``text`` cleaned by ``clean``, which is ``clean_early`` or ``clean_text``."""
    of_plain = _OF_PLAIN[clean]
    at = df.columns.index(text)
    cut = T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("plain", T.BooleanType())]))
    schema = T.StructType([T.StructField(f.name, cut if f.name == text else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, at):
            yield pa.RecordBatch.from_arrays([stretches(c) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    done = F.transform(text, lambda x: F.when(x["plain"], of_plain(x["s"])).otherwise(clean(x["s"])))
    return df.mapInArrow(run, schema).withColumn(text, F.array_join(F.filter(done, lambda s: s != ""), " "))
