"""Suffix-array dedup: bytes that an earlier document holds too.

A byte goes if a ``SIZE``-byte string that covers it also starts in a document
with a smaller id. Which strings those are, suffix arrays say: positions sorted
by Larsson-Sadakane refinement (ranks by 8, 16, 32, 64 bytes, only groups still
open are sorted again), Kasai's common prefixes along them (one lane a piece of
text, the bound carried from position to position), and classes of neighbours
that share ``SIZE`` bytes, each with its smallest document.

Strings have to meet for that without all of the corpus in one array:

* Every string has an anchor, the ``GRAM``-byte gram in it with the least hash
  (of equal ones the last). Equal strings have equal anchors at equal places. A
  run of strings with one anchor makes a piece of at most ``2 * SIZE - GRAM``
  bytes.
* Blocks of documents ask which anchors occur in another row too. Only pieces
  with such anchors are looked at further; no string is lost by that.
* Pieces are dealt by anchor over parts, each distinct one once a block with its
  smallest and largest document. A part cuts its sorted pieces into shards, builds
  an array for each, and merges the classes of anchors that lie in several
  shards by binary search. Its answer to a block is the smallest document of
  each run of strings of a piece.
* An anchor of more than ``HOT`` pieces would fill a part: its strings are dealt
  one by one, by their own hash. Equal ones still meet, and a block sends each
  once, so no key is hot.

Hashes only decide where strings meet; all matches are found on the bytes.

Null texts are empty. A document with a null id comes after all others: its
repeats go, it takes none from others. Rows with equal ids don't count as
smaller to each other. Texts may be of any length; they are never cut. Two
tables, blocks and answers, stay in the shared folder for the result to read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm import pack, pack_sorted, unpack, unpack_sorted
from .tables import remove, saved
from .words import mix, seeds, slices, text_bytes

SIZE = 50
GRAM = 24
DEPTH = 64
BLOCK_BYTES = 4 << 20
#: Bytes of text whose anchors are one part's; bytes of pieces of a part, of a shard.
PART_TEXT = 24 << 20
PART_PIECES = 12 << 20
SHARD_BYTES = 1 << 20
HOT = 20_000
NO_ID = np.iinfo(np.int64).max

_A, _B, _C = seeds(3, 7000)
_STRING = seeds(SIZE, 7100) | np.uint64(1)
_KEY_BITS = 48
_STEP = 1 << 15


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the gram at each of the first ``n`` bytes."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    h = (x[:n] ^ _A) * (_A | np.uint64(1))
    h ^= h >> np.uint64(29)
    h += (x[8 : 8 + n] ^ _B) * (_B | np.uint64(1))
    h ^= h >> np.uint64(31)
    h += (x[16 : 16 + n] ^ _C) * (_C | np.uint64(1))
    return mix(h)


class Runs(NamedTuple):
    """Runs of strings with one anchor: first string, number of strings, key of the anchor."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray


def anchor_runs(data: np.ndarray, bounds: np.ndarray) -> Runs:
    """All strings of ``SIZE`` bytes inside the rows, as runs in order."""
    n, reach = len(data), SIZE - GRAM + 1
    edge = np.zeros(n + 1, np.int8)
    lengths = np.diff(bounds)
    some = lengths > 0
    ends = bounds[1:][some]
    np.add.at(edge, np.maximum(ends - (SIZE - 1), bounds[:-1][some]), 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge, dtype=np.int8)[:n] == 0
    padded = np.concatenate([data, np.zeros(GRAM + SIZE, np.uint8)])
    low = np.uint64(0xFFFF)
    found = []
    for a in range(0, n, _STEP):
        m = min(_STEP, n - a)
        k = m + reach - 1
        h = _gram_hashes(padded[a : a + k + GRAM + 8], k)
        best = (h & ~low) | (low - np.arange(k, dtype=np.uint64))
        width = 1
        while width * 2 <= reach:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if reach > width:
            best = np.minimum(best[: width - reach], best[reach - width :])
        place = (low - (best & low)).astype(np.int32)
        ok = whole[a : a + m]
        turn = np.ones(m + 1, bool)
        turn[1:m] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
        at = np.flatnonzero(turn)
        start, count = at[:-1], np.diff(at)
        start, count = start[ok[start]], count[ok[start]]
        found.append((start + a, count, mix(h[place[start]]) >> np.uint64(64 - _KEY_BITS)))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all given stretches in a row, and their bounds."""
    bounds = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(bounds[-1], np.uint8)
    a = 0
    while a < len(start):
        # A slice at a time: an index takes eight times the room of the bytes.
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 20), side="right")) - 1)
        own = slice(bounds[a], bounds[b])
        out[own] = data[np.arange(own.start, own.stop) + np.repeat(start[a:b] - bounds[a:b], length[a:b])]
        a = b
    return out, bounds


def _binary(body: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


def _body(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, limit: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stretches: bytes, bounds, and each stretch's number among them."""
    total = np.cumsum(length)
    dictionaries, codes = [], []
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        encoded = _binary(*gather(data, start[at:to], length[at:to])).dictionary_encode()
        dictionaries.append(encoded.dictionary)
        codes.append(encoded.indices.to_numpy())
        at = to
    if not dictionaries:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    every = pa.concat_arrays(dictionaries).dictionary_encode()
    place = every.indices.to_numpy().astype(np.int64)
    first = np.cumsum([0, *(len(d) for d in dictionaries)])
    numbers = np.concatenate([place[f + c] for f, c in zip(first, codes, strict=False)])
    return *_body(every.dictionary), numbers


# Blocks -------------------------------------------------------------------

BLOCK = "block long, docs binary, bounds binary, body binary, n_bytes long"


class Block(NamedTuple):
    docs: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        sizes = unpack(row["bounds"], np.int64)
        return cls(unpack(row["docs"], np.int64), np.concatenate(([0], np.cumsum(sizes))), _open(row["body"]))

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (doc_id, _text)``, about ``BLOCK_BYTES`` of text each."""

    def one(held, number):
        sizes = np.concatenate([np.diff(b) for _, b, _ in held])
        data = np.concatenate([d for d, _, _ in held])
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "docs": pa.array([pack(np.concatenate([i for _, _, i in held]))], pa.binary()),
                "bounds": pa.array([pack(sizes)], pa.binary()),
                "body": pa.array([_squeeze(data.tobytes())], pa.binary()),
                "n_bytes": pa.array([len(data)], pa.int64()),
            }
        )

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0
        for piece in slices(batches, "_text", BLOCK_BYTES):
            data, bounds = text_bytes(piece.column("_text"))
            ids = piece.column("doc_id").fill_null(int(NO_ID)).to_numpy()
            held.append((np.array(data), np.array(bounds), np.array(ids)))
            size += len(data)
            if size >= BLOCK_BYTES // 2:
                yield one(held, part << 32 | number)
                held, size, number = [], 0, number + 1
        if held:
            yield one(held, part << 32 | number)

    return docs.mapInArrow(run, BLOCK)


def _part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin among sorted keys."""
    return np.searchsorted((keys * np.uint64(parts)) >> np.uint64(_KEY_BITS), np.arange(parts + 1, dtype=np.uint64))


# First question: which anchors occur in another row ------------------------


def _anchors(block: Block) -> tuple[Runs, np.ndarray, np.ndarray]:
    runs = anchor_runs(block.data, block.bounds)
    keys, of = np.unique(runs.key, return_inverse=True)
    return runs, keys, of


def ask_anchors(table: DataFrame, parts: int) -> DataFrame:
    """Per block and part: its sorted anchors, their numbers, and which lie in several rows."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                runs, keys, of = _anchors(block)
                rows = block.rows_of(runs.start)
                first, last = np.full(len(keys), len(block.docs)), np.full(len(keys), -1)
                np.minimum.at(first, of, rows)
                np.maximum.at(last, of, rows)
                number = np.bincount(of, minlength=len(keys)).astype(np.uint32)
                bounds = _part_bounds(keys, parts)
                some = np.flatnonzero(np.diff(bounds))
                cuts = [slice(bounds[j], bounds[j + 1]) for j in some]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(some, pa.int64()),
                        "block": pa.array([row["block"]] * len(some), pa.int64()),
                        "keys": pa.array([pack_sorted(keys[c]) for c in cuts], pa.binary()),
                        "number": pa.array([pack(number[c]) for c in cuts], pa.binary()),
                        "several": pa.array([pack((last > first)[c].view(np.uint8)) for c in cuts], pa.binary()),
                    }
                )

    return table.mapInArrow(run, "part long, block long, keys binary, number binary, several binary")


ANSWER = "block long, part long, told binary, n_kept long"


def answer_anchors(group: pa.Table) -> pa.Table:
    """To each block, in the order it asked: 0 for an anchor of one row, 1 for one of several, 2 for a hot one."""
    rows = group.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    asked = np.bincount(at)
    number = np.bincount(at, np.concatenate([unpack(r["number"], np.uint32) for r in rows]))
    several = np.bincount(at, np.concatenate([unpack(r["several"], np.uint8) for r in rows])) > 0
    shared = (asked > 1) | several
    code = (shared.astype(np.uint8) + (shared & (number > HOT)))[at]
    cuts = np.cumsum([0, *(len(k) for k in keys)])
    told = [code[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table(
        {
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "part": pa.array([r["part"] for r in rows], pa.int64()),
            "told": pa.array([pack(t) for t in told], pa.binary()),
            "n_kept": pa.array([int((t > 0).sum()) for t in told], pa.int64()),
        }
    )


# Second question: the smallest document of each string of a piece ----------


class Pieces(NamedTuple):
    """Distinct pieces of a block, sorted by key, and the places they occur at."""

    body: np.ndarray
    bounds: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    number: np.ndarray


def pieces(block: Block, told: np.ndarray) -> Pieces:
    """Pieces with shared anchors; those of hot anchors as single strings."""
    runs, _, of = _anchors(block)
    code = told[of]
    plain, hot = code == 1, np.flatnonzero(code == 2)
    first = np.repeat(runs.start[hot] - np.cumsum(runs.count[hot]) + runs.count[hot], runs.count[hot])
    single = first + np.arange(len(first))
    key = np.zeros(len(single), np.uint64)
    for j in range(SIZE):
        key += block.data[single + j].astype(np.uint64) * _STRING[j]
    start = np.concatenate([runs.start[plain], single])
    count = np.concatenate([runs.count[plain], np.ones(len(single), np.int64)])
    keys = np.concatenate([runs.key[plain], mix(key) >> np.uint64(64 - _KEY_BITS)])
    body, bounds, number = distinct(block.data, start, count + SIZE - 1)
    n = len(bounds) - 1
    own = np.zeros(n, np.uint64)
    own[number] = keys
    doc = block.docs[block.rows_of(start)]
    low, high = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    order = np.argsort(own, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    body, bounds = gather(body, bounds[:-1][order], np.diff(bounds)[order])
    return Pieces(body, bounds, own[order], low[order], high[order], start, place[number])


def _with(table: DataFrame, told: DataFrame, column: str, use, schema: str) -> DataFrame:
    """``use(block row, [(part, answer)])`` of every block; a block's rows stream in together."""
    asked = table.withColumns({"part": F.lit(-1).cast("long"), column: F.lit(None).cast("binary")})
    rows = asked.unionByName(told.select("block", "part", column), allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "part")

    def run(batches):
        row, got = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                if one["part"] < 0:
                    if row is not None:
                        yield from use(row, got)
                    row, got = one, []
                else:
                    got.append((one["part"], one[column]))
        if row is not None:
            yield from use(row, got)

    return dealt.mapInArrow(run, schema)


def _told(got: list[tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([unpack(x, np.uint8) for _, x in got]) if got else np.zeros(0, np.uint8)


PIECES = "part long, block long, keys binary, sizes binary, body binary, low binary, high binary, told binary"


def ask_pieces(table: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    def use(row, got):
        told = _told(got)
        found = pieces(Block.read(row), told)
        bounds = _part_bounds(found.key, parts)
        some = np.flatnonzero(np.diff(bounds))
        cuts = [slice(bounds[j], bounds[j + 1]) for j in some]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(some, pa.int64()),
                "block": pa.array([row["block"]] * len(some), pa.int64()),
                "keys": pa.array([pack_sorted(found.key[c]) for c in cuts], pa.binary()),
                "sizes": pa.array([pack(np.diff(found.bounds[c.start : c.stop + 1]).astype(np.uint8)) for c in cuts], pa.binary()),
                "body": pa.array([_squeeze(found.body[found.bounds[c.start] : found.bounds[c.stop]].tobytes()) for c in cuts], pa.binary()),
                "low": pa.array([pack(found.low[c]) for c in cuts], pa.binary()),
                "high": pa.array([pack(found.high[c]) for c in cuts], pa.binary()),
                "told": pa.nulls(len(some), pa.binary()),
            }
        )

    return _with(table, answers, "told", use, PIECES).drop("told")


# Suffix arrays --------------------------------------------------------------


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions sorted by their first ``DEPTH`` bytes, from the eight bytes at each.

    Larsson-Sadakane: a position's rank is the first slot of its group; groups
    of one are done, the others are sorted by the rank as many bytes further on
    as are sorted already.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    head = np.ones(n, bool)
    head[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while depth < DEPTH:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = np.minimum(at + depth, n)
        code = rank[at] * (n + 1) + np.append(rank, -1)[after] + 1
        again = np.argsort(code, kind="stable")
        at, code = at[again], code[again]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = code[1:] != code[:-1]
        head[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        depth *= 2
    return order


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the front of 64-bit numbers other than 0."""
    high = x >> np.uint64(32)
    upper = high > 0
    bits = np.frexp(np.where(upper, high, x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(upper, 0, 4) + (32 - bits) // 8


def common_prefixes(words: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bytes that each slot shares with the slot before it, ``DEPTH`` at most.

    Kasai: going from a position to the next, the common prefix with the
    predecessor shrinks by one at most. Every piece is a lane; all lanes take a
    step at a time. (Where ``DEPTH`` bytes agree the order beyond is open, so
    nothing is carried on from there.)
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([words, np.zeros(DEPTH + 8, np.uint64)])
    shared = np.zeros(n, np.int64)
    length = np.diff(bounds)
    lanes = np.argsort(-length, kind="stable")
    start, length = bounds[:-1][lanes], length[lanes]
    h = np.zeros(len(lanes), np.int64)
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = start[:live] + t
        other = before[at]
        h = h[:live]
        h = np.where((h > 0) & (h < DEPTH), h - 1, 0)
        open_ = np.flatnonzero(other >= 0)
        h[other < 0] = 0
        while len(open_):
            x = padded[at[open_] + h[open_]] ^ padded[other[open_] + h[open_]]
            same = x == 0
            h[open_] += np.where(same, 8, _leading_bytes(np.where(same, np.uint64(1), x)))
            open_ = open_[same]
            open_ = open_[h[open_] < DEPTH]
        np.minimum(h, DEPTH, out=h)
        shared[at] = h
    return shared[order]


class Shard(NamedTuple):
    """Strings of some pieces: the class of each, the classes' least documents, a place of each class."""

    window: np.ndarray
    owner: np.ndarray
    of: np.ndarray
    least: np.ndarray
    place: np.ndarray
    body: np.ndarray


def shard(body: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> Shard:
    """Classes of equal strings of the pieces, in the order of a suffix array."""
    words = np.concatenate([body, np.zeros(7, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        words = words[:-width] << np.uint64(8 * width) | words[width:]
    order = suffix_array(words)
    head = common_prefixes(words, order, bounds) < SIZE
    head[0] = True
    counts = np.diff(bounds) - SIZE + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    # Only classes with a whole string count; they keep their order.
    classes, of = np.unique(group[window], return_inverse=True)
    least = np.full(len(classes), NO_ID)
    np.minimum.at(least, of, doc[owner])
    place = np.zeros(len(classes), np.int64)
    place[of] = window
    return Shard(window, owner, of, least, place, body)


def _strings(found: Shard, classes: np.ndarray) -> np.ndarray:
    """The strings of sorted classes, as sorted fixed-width bytes."""
    rows = found.body[found.place[classes][:, None] + np.arange(SIZE)]
    return np.ascontiguousarray(rows).view(f"S{SIZE}").ravel()


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct strings with their least documents as one, by binary search."""
    (left, low), (right, other) = a, b
    at = np.searchsorted(left, right)
    same = np.zeros(len(right), bool)
    inside = at < len(left)
    same[inside] = left[at[inside]] == right[inside]
    low = low.copy()
    low[at[same]] = np.minimum(low[at[same]], other[same])
    new = ~same
    return np.insert(left, at[new], right[new]), np.insert(low, at[new], other[new])


def least_documents(body: np.ndarray, bounds: np.ndarray, key: np.ndarray, doc: np.ndarray, limit: int = SHARD_BYTES) -> np.ndarray:
    """The least document of every string of distinct pieces sorted by key, piece by piece."""
    n = len(bounds) - 1
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + limit, side="right")) - 1))
    shards = [shard(body[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], doc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    # Sorted by key, a key lies in two shards only across a cut.
    spread = np.unique([key[c] for c in cuts[1:-1] if key[c] == key[c - 1]])
    lists, told = [], []
    for found, a in zip(shards, cuts, strict=False):
        classes = np.unique(found.of[np.isin(key[a + found.owner], spread)]) if len(spread) else np.zeros(0, np.int64)
        told.append((classes, _strings(found, classes) if len(classes) else None))
        if len(classes):
            lists.append((told[-1][1], found.least[classes]))
    while len(lists) > 1:
        lists = [merge(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    out = []
    for found, (classes, strings) in zip(shards, told, strict=True):
        if len(classes):
            found.least[classes] = lists[0][1][np.searchsorted(lists[0][0], strings)]
        out.append(found.least[found.of])
    return np.concatenate(out)


REPLY = "block long, part long, reply binary, n_reply long"


def _spread_out(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``counts[i]`` of them, for every i."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + counts, counts)


def answer_pieces(group: pa.Table) -> pa.Table:
    """To each block: runs (piece in its order, first and end string, least document) that may remove something."""
    rows = group.to_pylist()
    sizes = [unpack(r["sizes"], np.uint8).astype(np.int64) for r in rows]
    size = np.concatenate(sizes)
    data = np.concatenate([_open(r["body"]) for r in rows])
    keys = np.concatenate([unpack_sorted(r["keys"]) for r in rows])
    low = np.concatenate([unpack(r["low"], np.int64) for r in rows])
    high = np.concatenate([unpack(r["high"], np.int64) for r in rows])
    body, bounds, number = distinct(data, np.cumsum(size) - size, size)
    n = len(bounds) - 1
    doc, key = np.full(n, NO_ID), np.zeros(n, np.uint64)
    np.minimum.at(doc, number, low)
    key[number] = keys
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    number = place[number]
    body, bounds = gather(body, bounds[:-1][order], np.diff(bounds)[order])
    least = least_documents(body, bounds, key[order], doc[order])
    counts = np.diff(bounds) - SIZE + 1
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(n), counts)
    turn = np.ones(len(least) + 1, bool)
    turn[1:-1] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(turn)
    run_from, run_to = at[:-1], at[1:]
    runs_of = np.searchsorted(owner[run_from], np.arange(n + 1))
    per = np.diff(runs_of)[number]
    asked = np.repeat(np.arange(len(number)), per)
    run = _spread_out(per, runs_of[number])
    useful = least[run_from[run]] < high[asked]
    asked, run = asked[useful], run[useful]
    begin = run_from[run] - first[number[asked]]
    cuts = np.cumsum([0, *(len(s) for s in sizes)])
    edges = np.searchsorted(asked, cuts)
    out = []
    for i, r in enumerate(rows):
        c = slice(edges[i], edges[i + 1])
        if c.stop > c.start:
            reply = np.stack([asked[c] - cuts[i], begin[c], begin[c] + (run_to - run_from)[run[c]], least[run_from[run[c]]]], axis=1)
            out.append((r["block"], r["part"], pack(reply.astype(np.int64).ravel()), len(reply)))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("block", "part", "reply", "n_reply"), columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)})


# Result ---------------------------------------------------------------------

RESULT = "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long, n_removed long, n_spans long"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def removed(block: Block, found: Pieces, replies: np.ndarray) -> np.ndarray:
    """Which bytes go, from replies (piece, first string, end string, least document)."""
    n = len(block.data)
    at = np.argsort(found.number, kind="stable")
    bounds = np.searchsorted(found.number[at], np.arange(len(found.key) + 1))
    per = np.diff(bounds)[replies[:, 0]]
    place = found.start[at[_spread_out(per, bounds[replies[:, 0]])]]
    reply = np.repeat(np.arange(len(replies)), per)
    earlier = replies[reply, 3] < block.docs[block.rows_of(place)]
    place, reply = place[earlier], reply[earlier]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, place + replies[reply, 1], 1)
    np.add.at(edge, place + replies[reply, 2] - 1 + SIZE, -1)
    return np.cumsum(edge)[:n] > 0


def _result(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    n, bounds = len(block.data), block.bounds
    starts_row = np.zeros(n + 1, bool)
    starts_row[bounds] = True
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1] | starts_row[1:n]
    ends[:-1] &= ~gone[1:] | starts_row[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = block.rows_of(begin)
    per_row = np.searchsorted(begin, bounds)
    removed_to = np.concatenate(([0], np.cumsum(gone)))[bounds]
    spans = pa.StructArray.from_arrays([pa.array(begin - bounds[row], pa.int64()), pa.array(end - bounds[row], pa.int64())], fields=list(SPAN))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(block.docs, pa.int64(), mask=block.docs == NO_ID),
            "kept": _binary(block.data[~gone], bounds - removed_to).cast(pa.binary()),
            "spans": pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), spans),
            "n_bytes": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(np.diff(removed_to), pa.int64()),
            "n_spans": pa.array(np.diff(per_row), pa.int64()),
        }
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kept, spans, n_bytes, n_removed, n_spans)`` of every row of ``docs``.

    ``kept`` has the bytes that stay, ``spans`` the maximal removed runs as byte
    offsets. Kept bytes may end inside a character, as strings are of bytes.
    """
    spark = docs.sparkSession
    folders: list[str] = []
    try:
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
        table = saved(blocks(rows), "text-blocks", folders)
        total = table.agg(F.sum("n_bytes")).first()[0] or 0
        parts = max(1, -(-total // PART_TEXT))
        asked = ask_anchors(table, parts).groupBy("part").applyInArrow(answer_anchors, ANSWER)
        answers = saved(asked, "anchors", folders)
        kept = answers.agg(F.sum("n_kept")).first()[0] or 0
        parts = max(1, -(-(kept * (2 * SIZE - GRAM)) // PART_PIECES))
        told = ask_pieces(table, answers, parts).groupBy("part").applyInArrow(answer_pieces, REPLY)
        replies = saved(told, "replies", folders)
    except BaseException:
        remove(spark, folders)
        raise

    def use(row, got):
        mine = [(p, x) for p, x in got if x[0:1] == b"r"]
        block = Block.read(row)
        found = pieces(block, _told([(p, x[1:]) for p, x in got if x[0:1] == b"a"]))
        bounds = _part_bounds(found.key, parts)
        tables = []
        for p, x in mine:
            reply = unpack(x[1:], np.int64).reshape(-1, 4)
            reply[:, 0] += bounds[p]
            tables.append(reply)
        gone = removed(block, found, np.concatenate(tables)) if tables else np.zeros(len(block.data), bool)
        yield _result(block, gone)

    both = answers.select("block", "part", F.concat(F.lit(b"a"), "told").alias("told")).unionByName(
        replies.select("block", "part", F.concat(F.lit(b"r"), "reply").alias("told"))
    )
    return _with(table, both, "told", use, RESULT)
