"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, word pairs and pairs with one word between are hashed into a fixed number
of coordinates; a document has a coordinate or has it not, however often the
gram occurs. FTRL-proximal gives every coordinate its own learning rate and an
L1 threshold, so most weights are exactly zero and what is left is small.

Training runs as one Spark job: the learning rows are dealt over shards by
their hash, each shard trains on its own rows, and the mean of the shards'
weights is the model. The model's size is bounded by the number of coordinates
(``2 ** BITS``), whatever the corpus; only that is broadcast. Scoring is one
pass over the documents without a shuffle.

Null texts count as empty and get the bias alone. Documents whose label is null
are not learned from. If no labelled rows are left, every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name
from .words import find_words, seeds, slices, text_bytes

BITS = 20
#: Learning rows at most, those with the lowest hash of their id.
MAX_ROWS = 24_000
SHARDS = 2
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0


def grams(words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and document number of every gram of a slice; repeats included."""
    mask = np.uint64((1 << bits) - 1)
    pair, skip = seeds(2, 3000)
    found, docs = [words.hash & mask], [words.doc]
    for gap, seed in ((1, pair), (2, skip)):
        left, right = words.hash[:-gap], words.hash[gap:]
        same = words.doc[:-gap] == words.doc[gap:]
        mixed = ((left ^ seed) * (seed | np.uint64(1)) + right) >> np.uint64(64 - bits)
        found.append(mixed[same])
        docs.append(words.doc[:-gap][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs)


class Ftrl:
    """FTRL-proximal state: one gradient sum and one squared sum a coordinate."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a document with the coordinates ``at`` (each once)."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(batches):
    """Train on all rows of a shard; give its non-zero weights, the bias last."""
    size = 1 << BITS
    rows = []
    for part in slices(batches, "text"):
        words = find_words(*text_bytes(part.column("text")))
        at, doc = grams(words)
        key = np.unique(doc * size + at)
        cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * size)
        labels = part.column("label").to_numpy(zero_copy_only=False)
        for i, label in enumerate(labels):
            rows.append((np.append(key[cuts[i] : cuts[i + 1]] & (size - 1), size).astype(np.int32), int(label)))
    if not rows:
        return
    model = Ftrl(size + 1)
    for _ in range(EPOCHS):
        for at, label in rows:
            model.learn(at, label)
    w = model.weights()
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w[kept])], names=["at", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights (bias last) from the documents that ``labels (doc_id, label 0/1)`` names.

    The ``max_rows`` rows with the lowest id hash are used, of both classes as
    they come, so the odds of the classes, and with them what a score means, are
    those of all labelled rows. That bound is a parameter of training only;
    scoring has none. It also bounds the id list that is broadcast to pick their
    texts, so no text is shuffled but theirs.
    """
    rows = labels.filter("label in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("order", F.xxhash64("_id", F.lit(7)))
    sample = rows.orderBy("order", "label").limit(max_rows)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("text"))
    named = texts.join(F.broadcast(sample), F.col("_key") == F.col("_id")).select("text", "label", "order")
    dealt = named.repartition(shards, "order").sortWithinPartitions("order", "label")
    parts = dealt.select("text", "label").mapInArrow(_train, "at long, weight double").toArrow()
    total = np.zeros((1 << BITS) + 1)
    if parts.num_rows:
        at = parts.column("at").to_numpy()
        np.add.at(total, at, parts.column("weight").to_numpy() / shards)
    return total


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic in the last column.

    It is called ``to``, with ``_`` before it where ``docs`` has that name.
    """
    to = free_name(docs.columns, to)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(weights.astype(np.float32))
    trained = bool(np.any(weights))
    fields = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])
    at_text = docs.columns.index(text)

    def run(batches):
        w = table.value
        for part in slices(batches, text_name):
            words = find_words(*text_bytes(part.column(at_text)))
            at, doc = grams(words)
            hit = np.flatnonzero(w[at])
            key = np.unique(doc[hit] * np.int64(len(w)) + at[hit])
            total = np.bincount(key // len(w), w[key % len(w)], minlength=part.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30))) if trained else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, to])

    text_name = docs.columns[at_text]
    return docs.mapInArrow(run, fields)
