"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The index is of the test items, the queries are the passages of every document:
windows of ``2 * stride`` words, one every ``stride`` words, so that any run of
``stride`` words lies whole in one of them. Items longer than ``stride`` words
are indexed in pieces. A piece's score for a passage is the BM25 weight of its
terms in the passage as a share of its own total weight, so one threshold holds
for all. All pieces above it are retrieved.

Retrieval is document-at-a-time for a whole Arrow batch at once and never scores
what can't pass. A piece's rarest terms are its essential ones: the weight of
the others stays below the threshold, so a passage must hold an essential term.
Essential terms first add up the block maxima of blocks of pieces; blocks whose
bound stays below the threshold are skipped, then pieces by their own bounds,
and only what is left is scored.

A retrieved item is verified in the whole document: the share of its five-word
shingles that occur there, for its question and its answer apart. The question
ends at the first line break or question mark, else in the middle. Both shares
must reach ``least``; parts too short for a shingle are looked up as they are.

The items are taken in groups of at most ``GROUP_WORDS`` words, one pass over
the documents each: that bounds what is broadcast and leaves out nothing.
Null and empty texts and items match nothing. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import find_words, mix, seeds, slices, text_bytes

THRESHOLD = 0.5
LEAST = 0.6
STRIDE = 64
SHINGLE = 5
BLOCK = 8
GROUP_WORDS = 2_000_000
SPARE = 0.5
K1, B = 1.2, 0.75

_BREAK = re.compile(r"[?\n]")


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    found = _BREAK.search(text)
    if found and text[: found.end()].split() and text[found.end() :].split():
        return text[: found.end()], text[found.end() :]
    words = text.split()
    middle = len(words) // 2
    return " ".join(words[:middle]), " ".join(words[middle:])


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in one text's word hashes."""
    n = len(hashes) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j, seed in enumerate(seeds(size, 1000)):
        total += (hashes[j : j + max(n, 0)] ^ seed) * (seed | np.uint64(1))
    return mix(total)


def word_hashes(text: str) -> np.ndarray:
    return find_words(*text_bytes(pa.array([text]))).hash


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass
class Lists:
    """Rows of lists: the ids and weights of list t lie between ``at[t]`` and ``at[t + 1]``."""

    at: np.ndarray
    ids: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, owner: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int) -> Lists:
        order = np.lexsort((ids, owner))
        return cls(np.searchsorted(owner[order], np.arange(n + 1)), ids[order], weight[order])

    def spread(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each owner in turn its list: position in ``owners``, id and weight."""
        size = self.at[owners + 1] - self.at[owners]
        row = np.repeat(np.arange(len(owners)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + self.at[owners][row]
        return row, self.ids[place], self.weight[place]


class Index:
    """Terms, essential postings, block maxima and bounds of a group of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, stride: int = STRIDE):
        self.threshold, self.stride = threshold, stride
        self.items = [(i, *map(word_hashes, halves(text))) for i, text in items]
        pieces, self.item_of = [], []
        for number, (_, text) in enumerate(items):
            words = word_hashes(text)
            for start in range(0, len(words), stride):
                pieces.append(words[start : start + stride])
                self.item_of.append(number)
        self.vocabulary = np.unique(np.concatenate([*pieces, np.zeros(0, np.uint64)]))
        n, mean = len(pieces), np.mean([len(p) for p in pieces]) if pieces else 1.0
        term, piece, tf = [], [], []
        for number, words in enumerate(pieces):
            own, count = np.unique(np.searchsorted(self.vocabulary, words), return_counts=True)
            term.append(own)
            piece.append(np.full(len(own), number))
            tf.append(count * (K1 + 1) / (count + K1 * (1 - B + B * len(words) / mean)))
        term, piece, tf = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((term, np.int64), (piece, np.int64), (tf, float)))
        df = np.bincount(term, minlength=len(self.vocabulary))
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * tf
        weight /= np.bincount(piece, weight, minlength=max(n, 1))[piece]
        self.terms = Lists.of(piece, term, weight, n)
        # Per piece, the frequent terms whose weights together stay below SPARE of the threshold aren't essential.
        order = np.lexsort((-df[term], piece))
        before = np.cumsum(weight[order]) - np.repeat(
            np.concatenate(([0], np.cumsum(np.bincount(piece, weight, minlength=n))))[:-1], np.bincount(piece, minlength=n)
        )
        spare = before < threshold * SPARE
        self.rest = np.bincount(piece[order][spare], weight[order][spare], minlength=n)
        term, piece, weight = (x[order][~spare] for x in (term, piece, weight))
        self.postings = Lists.of(term, piece, weight, len(self.vocabulary))
        self.blocks = -(-n // BLOCK)
        self.block_rest = np.array([self.rest[i * BLOCK : (i + 1) * BLOCK].max() for i in range(self.blocks)])
        key, row = np.unique(term * max(self.blocks, 1) + piece // BLOCK, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, row, weight)
        self.block_lists = Lists.of(key // max(self.blocks, 1), key % max(self.blocks, 1), most, len(self.vocabulary))

    def retrieve(self, words) -> list[tuple[int, int, float]]:
        """``(document number, item number, best score)`` of all that reach the threshold."""
        if not len(self.vocabulary) or not len(words.hash):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words.hash)
        term = at[known]
        part = (known - words.first[words.doc[known]]) // self.stride
        windows = np.maximum(1, -(-words.per_doc // self.stride) - 1)
        base = np.concatenate(([0], np.cumsum(windows)))
        doc = words.doc[known]
        late, early = np.minimum(part, windows[doc] - 1), np.maximum(part - 1, 0)
        own = self.postings.at[term + 1] > self.postings.at[term]
        size = len(self.vocabulary)
        both = distinct(np.concatenate([((base[doc] + w) * size + term)[own] for w in (late, early)]))
        window, hit = both // size, both % size
        # Blocks first, by their maxima.
        row, block, most = self.block_lists.spread(hit)
        key, at_key = np.unique(window[row] * self.blocks + block, return_inverse=True)
        bound = np.bincount(at_key, most, minlength=len(key)) + self.block_rest[key % self.blocks if self.blocks else key]
        key = key[bound >= self.threshold]
        if not len(key):
            return []
        # Then the pieces of the blocks left, by their own bounds.
        inside = np.isin(window, key // self.blocks)
        row, piece, weight = self.postings.spread(hit[inside])
        where = window[inside][row]
        left = np.isin(where * self.blocks + piece // BLOCK, key)
        n = len(self.item_of)
        pairs, at_pair = np.unique(where[left] * n + piece[left], return_inverse=True)
        bound = np.bincount(at_pair, weight[left], minlength=len(pairs)) + self.rest[pairs % n]
        pairs = pairs[bound >= self.threshold]
        if not len(pairs):
            return []
        # Full scores of what is left: each piece's terms looked up in its passage.
        everything = distinct(np.concatenate([(base[doc] + w) * size + term for w in (late, early)]))
        row, own_term, weight = self.terms.spread(pairs % n)
        wanted = (pairs // n)[row] * size + own_term
        place = np.minimum(np.searchsorted(everything, wanted), len(everything) - 1)
        score = np.bincount(row, weight * (everything[place] == wanted), minlength=len(pairs))
        best: dict[tuple[int, int], float] = {}
        for at_pair in np.flatnonzero(score >= self.threshold):
            w, p = divmod(int(pairs[at_pair]), n)
            name = (int(np.searchsorted(base, w, side="right")) - 1, self.item_of[p])
            best[name] = max(best.get(name, 0.0), float(score[at_pair]))
        return [(d, item, score) for (d, item), score in sorted(best.items())]


def overlap(part: np.ndarray, text: np.ndarray, size: int = SHINGLE) -> float:
    """Share of a part's shingles that occur among a text's word hashes."""
    if not len(part):
        return 1.0
    size = min(size, len(part))
    wanted = np.unique(run_hashes(part, size))
    return float(np.isin(wanted, run_hashes(text, size)).mean())


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    least: float = LEAST,
) -> DataFrame:
    """``(doc_id, item_id, bm25, question_overlap, answer_overlap)`` of verified leaks."""
    spark = docs.sparkSession
    rows = items.select(F.col(item).cast("long").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).filter("trim(t) <> ''")
    queries = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))

    def search(group: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(group, threshold))

        def run(batches):
            for part in slices(batches, "_text"):
                words = find_words(*text_bytes(part.column("_text")))
                found = []
                for d, number, score in index.value.retrieve(words):
                    own = words.hash[words.first[d] : words.first[d + 1]]
                    name, question, answer = index.value.items[number]
                    shares = overlap(question, own), overlap(answer, own)
                    if min(shares) >= least:
                        found.append((part.column("doc_id")[d].as_py(), name, score, *shares))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)],
                        names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"],
                    )

        return queries.mapInArrow(run, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")

    out, group, held = None, [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        size = len(r.t.split())
        if group and held + size > GROUP_WORDS:
            out = search(group) if out is None else out.unionByName(search(group))
            group, held = [], 0
        group.append((r.i, r.t))
        held += size
    last = search(group)
    return last if out is None else out.unionByName(last)
