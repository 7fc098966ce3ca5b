"""Language-model scoring by deleted interpolation of n-gram estimates.

The model mixes the maximum-likelihood bigram, unigram and uniform estimates. The
mixture weights depend on how often the context was seen (one bucket for each
power of two) and are learned by expectation-maximisation on deleted counts:
every training token is predicted from the counts without itself.

Counts cover all training documents and are never held in one place. Documents
are cut into blocks of about ``BLOCK_BYTES`` of text, written once as token
numbers. A block asks for the counts of its distinct grams; the requests are
dealt by gram hash over as many parts as there are grams for, each part adds up
the counts of its grams (one entry per block and gram, so no gram is hot) and
answers every block. Blocks then score their documents with the counts they
asked for. What EM needs is a histogram of (bucket, bigram bin, unigram bin),
whose size doesn't depend on the corpus.

Words are lowered runs without white space; each text ends with an end token;
its first token has the beginning as context. Null texts are empty: one token.
Documents with a null id are scored, and learned from if ``train`` says so.
With no training document at all, only the uniform estimate is left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remove, saved
from .words import find_words, mix, seeds, slices, text_bytes

BLOCK_BYTES = 6 << 20
PART_GRAMS = 1_000_000
BUCKETS = 64
BINS_PER_OCTAVE = 4
ROUNDS = 60

_BEGIN, _END, _PAIR = seeds(3, 5000)


def pack(values: np.ndarray) -> bytes:
    """Compressed integers, byte planes apart."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


class Grams(NamedTuple):
    """Distinct grams of a block and, per token, the number of its own."""

    words: np.ndarray
    word_of: np.ndarray
    context_of: np.ndarray
    pairs: np.ndarray
    pair_of: np.ndarray


def grams(words: np.ndarray, word_of: np.ndarray, sizes: np.ndarray) -> Grams:
    """Bigrams from a block's sorted word hashes, token numbers and document sizes."""
    begin = int(np.searchsorted(words, _BEGIN))
    context = np.empty_like(word_of)
    context[1:] = word_of[:-1]
    context[(np.cumsum(sizes) - sizes)[sizes > 0]] = begin
    code = context.astype(np.int64) << 32 | word_of
    codes, pair_of = np.unique(code, return_inverse=True)
    hashes = mix((words[codes >> 32] ^ _PAIR) * (_PAIR | np.uint64(1)) + words[codes & 0xFFFFFFFF])
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Grams(words, word_of, context, hashes[order], place[pair_of])


BLOCK = "block long, docs array<long>, train array<boolean>, sizes array<int>, words binary, tokens binary, n_grams long"


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (doc_id, train, _text)`` as token numbers."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0
        for piece in slices(batches, "_text"):
            words = find_words(*text_bytes(piece.column("_text")))
            ends = words.first[1:]
            held.append((np.insert(words.hash, ends, _END), words.per_doc + 1, piece.column("doc_id").to_pylist(), piece.column("train").to_pylist()))
            size += piece.column("_text").nbytes
            if size >= BLOCK_BYTES:
                yield one(held, part << 32 | number)
                held, size, number = [], 0, number + 1
        if held:
            yield one(held, part << 32 | number)

    def one(held, number):
        stream = np.concatenate([x[0] for x in held])
        sizes = np.concatenate([x[1] for x in held])
        words = np.unique(np.append(stream, _BEGIN))
        tokens = np.searchsorted(words, stream).astype(np.uint32)
        found = grams(words, tokens.astype(np.int64), sizes)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "docs": pa.array([sum((x[2] for x in held), [])], pa.list_(pa.int64())),
                "train": pa.array([sum((x[3] for x in held), [])], pa.list_(pa.bool_())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
                "words": pa.array([pack_sorted(words)], pa.binary()),
                "tokens": pa.array([pack(tokens)], pa.binary()),
                "n_grams": pa.array([len(words) + len(found.pairs)], pa.int64()),
            }
        )

    return docs.mapInArrow(run, BLOCK)


class Block(NamedTuple):
    docs: list
    train: np.ndarray
    sizes: np.ndarray
    grams: Grams

    @classmethod
    def read(cls, row: dict) -> Block:
        sizes = np.array(row["sizes"], np.int64)
        tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        return cls(row["docs"], np.array(row["train"], bool), sizes, grams(unpack_sorted(row["words"]), tokens, sizes))


def _requests(table: DataFrame, parts: int) -> DataFrame:
    """Per block, kind and part: the sorted grams and their training counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.read(row)
                learn = np.repeat(block.train, block.sizes)
                g = block.grams
                begin = np.searchsorted(g.words, _BEGIN)
                counts = np.bincount(g.word_of[learn], minlength=len(g.words))
                counts[begin] = (block.train & (block.sizes > 0)).sum()
                for kind, keys, n in (("w", g.words, counts), ("p", g.pairs, np.bincount(g.pair_of[learn], minlength=len(g.pairs)))):
                    cut = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    bounds = np.searchsorted(cut, np.arange(parts + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(bounds))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(some, pa.int64()),
                            "block": pa.array([row["block"]] * len(some), pa.int64()),
                            "kind": pa.array([kind] * len(some)),
                            "keys": pa.array([pack_sorted(keys[bounds[j] : bounds[j + 1]]) for j in some], pa.binary()),
                            "counts": pa.array([pack(n[bounds[j] : bounds[j + 1]].astype(np.uint32)) for j in some], pa.binary()),
                        }
                    )

    return table.mapInArrow(run, "part long, block long, kind string, keys binary, counts binary")


def _answer(group: pa.Table) -> pa.Table:
    """Total counts of a part's grams, for each block in the order it asked."""
    rows = group.to_pylist()
    out = {"block": [], "part": [], "kind": [], "counts": [], "types": [], "tokens": []}
    for kind in ("w", "p"):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        keys = [unpack_sorted(r["keys"]) for r in own]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(r["counts"], np.uint32) for r in own])).astype(np.int64)
        start = 0
        for r, k in zip(own, keys, strict=True):
            mine = at[start : start + len(k)]
            start += len(k)
            for name, value in zip(out, (r["block"], r["part"], kind, pack(total[mine]), None, None), strict=True):
                out[name].append(value)
        if kind == "w":
            real = (every != _BEGIN) & (total > 0)
            for name, value in zip(out, (None, rows[0]["part"], "s", None, int(real.sum()), int(total[real].sum())), strict=True):
                out[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), kinds, strict=True)})


ANSWER = "block long, part long, kind string, counts binary, types long, tokens long"


class Counts(NamedTuple):
    """Training counts for every token of a block."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray


def _answered(table: DataFrame, answers: DataFrame, use, schema: str) -> DataFrame:
    """``use(block, counts)`` of each block with its answers; rows of a block stream in together."""
    asked = table.drop("n_grams").withColumns({"kind": F.lit("a"), "part": F.lit(0).cast("long"), "counts": F.lit(None).cast("binary")})
    told = answers.filter("kind <> 's'").select("block", "kind", "part", "counts")
    rows = asked.unionByName(told, allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "part")

    def run(batches):
        row, got = None, {}

        def finish():
            block = Block.read(row)
            g = block.grams
            word = np.concatenate(got["w"])
            return use(block, Counts(word[g.word_of], word[g.context_of], np.concatenate(got["p"])[g.pair_of]))

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                if one["kind"] == "a":
                    if row is not None:
                        yield finish()
                    row, got = one, {"w": [], "p": []}
                else:
                    got[one["kind"]].append(unpack(one["counts"], np.int64))
        if row is not None:
            yield finish()

    return dealt.mapInArrow(run, schema)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of its count's binary logarithm."""
    out = np.zeros(len(context), np.int64)
    seen = context > 0
    out[seen] = np.floor(np.log2(context[seen])).astype(np.int64) + 1
    return out


def _bins(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.floor(-np.log2(p[some]) * BINS_PER_OCTAVE).astype(np.int64)
    return out


def _deleted(block: Block, counts: Counts, tokens: int) -> pa.RecordBatch:
    """Histogram of the estimates of a block's training tokens without themselves."""
    learn = np.repeat(block.train, block.sizes)
    word, context, pair = (c[learn] - 1 for c in counts)
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    p1 = word / max(tokens - 1, 1)
    cells = pd.DataFrame({"bucket": bucket(context), "b2": _bins(p2), "b1": _bins(p1), "p2": p2, "p1": p1, "n": 1.0})
    sums = cells.groupby(["bucket", "b2", "b1"], as_index=False).sum()
    return pa.RecordBatch.from_pandas(sums, preserve_index=False)


def learn_weights(cells: pd.DataFrame, types: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket, by EM on the histogram."""
    p0 = 1 / (types + 1)
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS + 1, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for b, own in cells.groupby("bucket"):
        n = own["n"].to_numpy()
        p = np.stack([own["p2"] / n, own["p1"] / n, np.full(len(own), p0)], axis=1)
        w = weights[b]
        for _ in range(ROUNDS):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + 1e-3 * (w > 0)
            w /= w.sum()
        weights[b] = w
    return weights


SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(block: Block, counts: Counts, weights: np.ndarray, types: int, tokens: int) -> pa.RecordBatch:
    """Log10 probability of each document, interpolated and by the smoothed unigram."""
    word, context, pair = counts
    w = weights[bucket(context)]
    p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
    base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    n = len(block.sizes)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(block.docs, pa.int64()),
            "train": pa.array(block.train),
            "n_tokens": pa.array(block.sizes, pa.int64()),
            "n_known": pa.array(np.bincount(doc[word > 0], minlength=n), pa.int64()),
            "base_score": pa.array(np.bincount(doc, base, minlength=n)),
            "score": pa.array(np.bincount(doc, np.log10(p), minlength=n)),
        }
    )


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, train, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    ``train`` is a condition on ``docs``: the documents the model learns from.
    """
    spark = docs.sparkSession
    folders: list[str] = []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(text, F.lit("")).alias("_text"))
    table = saved(blocks(rows), "blocks", folders)
    total = table.agg(F.sum("n_grams")).first()[0] or 0
    parts = int(max(1, -(-total // PART_GRAMS)))
    asked = _requests(table, parts)
    answers = saved(asked.groupBy("part").applyInArrow(_answer, ANSWER), "counts", folders)
    sizes = answers.filter("kind = 's'").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = sizes[0] or 0, sizes[1] or 0
    cells = _answered(table, answers, lambda b, c: _deleted(b, c, tokens), "bucket long, b2 long, b1 long, p2 double, p1 double, n double")
    cells = cells.groupBy("bucket", "b2", "b1").agg(*[F.sum(c).alias(c) for c in ("p2", "p1", "n")]).toPandas()
    weights = learn_weights(cells.sort_values(["bucket", "b2", "b1"]), types)
    if not tokens:
        weights[:] = [0.0, 0.0, 1.0]
    found = _answered(table, answers, lambda b, c: _scores(b, c, weights, types, tokens), SCORE)
    out = saved(found.withColumn("train_tokens", F.lit(tokens).cast("long")), "scores")
    remove(spark, folders)
    return out
