"""Text classifiers: features fitted as a table, applied to any rows, three models.

``fit_features`` learns from training rows what their features need and keeps it
as one table: the terms of each text column with their weights and positions,
mean and deviation of number columns, the words of a lexicon. The table can be
written and read again; ``Features.apply`` then gives any rows their vectors,
sparse ones, as ``(key, size, indices, values)``. What is joined to the rows is
bounded by ``max_features`` a column.

Null texts are empty. Terms, words and numbers that training rows didn't have
are left out of a vector; a null number counts as the mean.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_counters
from ..session import materialize, scratch_path
from . import features as M

STATE = "part string, name string, term string, position int, value double"


@dataclass(frozen=True)
class TextColumn:
    """How the words of a text column become features.

    Tokens are runs of two word characters and more, in lower case, without
    ``stop_words``; terms are their runs of the given ``sizes``. Terms in fewer
    than ``min_df`` texts or more than the share ``max_df`` go, then all but the
    ``max_features`` most frequent. ``weight`` is "tf-idf", "log tf-idf", "count"
    or "binary"; the first two are scaled to length 1 a text.
    """

    name: str
    sizes: tuple[int, ...] = (1, 2)
    min_df: int = 2
    max_df: float = 1.0
    max_features: int = 5000
    weight: str = "tf-idf"
    stop_words: tuple[str, ...] = ()

    def terms(self, df: DataFrame, key: str) -> DataFrame:
        return M.term_counts(df, key, vectoriser_tokens(F.col(self.name), self.stop_words), self.sizes)


def vectoriser_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of two word characters and more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    if not stop_words:
        return found
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


class _Known:
    """The terms of a text column as numbers, and the cells they give rows of tokens."""

    def __init__(self, column: TextColumn, rows: Sequence):
        self.column = column
        terms = [r.term.split(" ") for r in rows]
        self.words = pa.array(sorted({w for t in terms for w in t}), pa.string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.base = max(1, len(place))
        # A run of words is one number, so it has to fit.
        self.fits = self.base ** max(column.sizes) < 1 << 62
        self.runs = {}
        for n in column.sizes if self.fits else ():
            own = sorted((self._number([place[w] for w in t]), r.position, r.value) for t, r in zip(terms, rows, strict=True) if len(t) == n)
            self.runs[n] = tuple(np.array(x, kind) for x, kind in zip(zip(*own, strict=True), (np.int64, np.int64, np.float64), strict=True)) if own else None

    def _number(self, ids):
        number = 0
        for i in ids:
            number = number * self.base + i
        return number

    def cells(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, position and value of every known term, by row and position."""
        word = pc.fill_null(pc.index_in(lists.flatten(), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [np.zeros((3, 0))]
        for n, own in self.runs.items():
            many = len(word) - n + 1
            if own is None or many <= 0:
                continue
            whole = row[:many] == row[n - 1 :]
            for i in range(n):
                whole &= word[i : i + many] >= 0
            at = np.flatnonzero(whole)
            number = self._number([word[at + i] for i in range(n)])
            term = np.minimum(np.searchsorted(own[0], number), len(own[0]) - 1)
            hit = own[0][term] == number
            pairs, tf = np.unique(row[at[hit]] * len(own[0]) + term[hit], return_counts=True)
            row_of, term = np.divmod(pairs, len(own[0]))
            idf = own[2][term]
            value = {"tf-idf": tf * idf, "log tf-idf": (1 + np.log(tf)) * idf, "count": tf, "binary": np.ones(len(tf))}[self.column.weight]
            found.append(np.stack([row_of, own[1][term], value]))
        row_of, position, value = np.concatenate(found, axis=1)
        row_of, position = row_of.astype(np.int64), position.astype(np.int32)
        order = np.lexsort((position, row_of))
        row_of, position, value = row_of[order], position[order], value[order]
        if "idf" in self.column.weight:
            value = value / np.sqrt(np.bincount(row_of, value * value, minlength=1))[row_of]
        return row_of, position, value


def _vectors(batches: Iterator[pa.RecordBatch], known: Sequence[_Known]) -> Iterator[pa.RecordBatch]:
    """Batches ``(key, single numbers, a list of tokens per text column)`` as ``(key, indices, values, single numbers)``."""
    for batch in batches:
        lists = batch.columns[2:]
        ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + M.COUNTED_TOKENS, side="right")))
            parts = [k.cells(x.slice(at, to - at)) for k, x in zip(known, lists, strict=True)]
            row, position, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Positions rise from column to column.
            order = np.argsort(row, kind="stable")
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=to - at)))).astype(np.int32))
            cells = [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (position, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *cells, batch.column(1).slice(at, to - at)], names=["key", "indices", "values", "singles"])
            at = to


def _kept_terms(df: DataFrame, key: str, column: TextColumn) -> DataFrame:
    """``(term, weight)`` of the terms that stay."""
    counts = column.terms(df, key).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    # One row.
    kept = counts.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))), how="cross").where(
        (F.col("df") >= column.min_df) & (F.col("df") <= F.col("n") * F.lit(float(column.max_df)))
    )
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if "idf" in column.weight else F.lit(1.0)
    return kept.orderBy(F.desc("tf"), "term").limit(column.max_features).select("term", idf.alias("value"))


@dataclass(frozen=True)
class Features:
    """What was fitted: the columns, and the table ``(part, name, term, position, value)``."""

    texts: tuple[TextColumn, ...]
    numbers: tuple[str, ...]
    counted: tuple[str, ...]
    polarity: str | None
    shift: float
    table: DataFrame = field(compare=False)
    size: int = 0

    def save(self, path: str) -> None:
        """The table, and the columns as one more row of it."""
        plan = {"texts": [asdict(t) for t in self.texts], "numbers": self.numbers, "counted": self.counted, "polarity": self.polarity, "shift": self.shift, "size": self.size}
        spark = self.table.sparkSession
        row = spark.createDataFrame([("plan", None, json.dumps(plan), None, None)], STATE)
        self.table.select("part", "name", "term", "position", "value").unionByName(row).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Features:
        table = spark.read.schema(T.StructType.fromDDL(STATE)).parquet(path)
        plan = json.loads(table.where("part = 'plan'").first().term)
        texts = tuple(TextColumn(**{**t, "sizes": tuple(t["sizes"]), "stop_words": tuple(t["stop_words"])}) for t in plan["texts"])
        return cls(texts, tuple(plan["numbers"]), tuple(plan["counted"]), plan["polarity"], plan["shift"], table.where("part <> 'plan'"), plan["size"])

    def _part(self, part: str, name: str) -> DataFrame:
        return self.table.where((F.col("part") == part) & (F.col("name") == name))

    def cells(self, df: DataFrame, key: str) -> DataFrame:
        """``(key, position, value)`` of every feature of a row that isn't 0."""
        parts = []
        for column in self.texts:
            known = F.broadcast(self._part("term", column.name).select("term", "position", "value"))
            counts = column.terms(df, key).join(known, "term")
            tf = F.col("tf").cast("double")
            raw = {"tf-idf": tf * F.col("value"), "log tf-idf": (1 + F.log(tf)) * F.col("value"), "count": tf, "binary": F.lit(1.0)}[column.weight]
            cells = counts.select(key, "position", raw.alias("value"))
            if "idf" in column.weight:
                # A row's terms lie together already, so its length takes no other shuffle.
                length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
                cells = cells.select(key, "position", (F.col("value") / length).alias("value"))
            parts.append(cells)
        first = sum(t.max_features for t in self.texts)
        singles = [c.cast("double") for c in self._singles(df).values()]
        row = df
        if self.polarity is not None:
            lexicon = self._part("word", self.polarity).select(F.col("term").alias("word"), F.col("value").alias("polarity"))
            found = M.polarity(df.select(key, self.polarity), key, self.polarity, lexicon).withColumnRenamed("polarity", "__polarity")
            row = df.join(found, key, "left")
            singles.append(F.coalesce("__polarity", F.lit(0.0)) + self.shift)
        if self.numbers:
            scales = {(r.name, r.term): r.value for r in self.table.where("part = 'scale'").collect()}
            singles = [*[self._scaled(n, scales) for n in self.numbers], *singles]
        if singles:
            numbered = F.array(*[F.struct(F.lit(first + i).alias("position"), c.alias("value")) for i, c in enumerate(singles)])
            parts.append(row.select(key, F.inline(numbered)))
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        return every.where("value <> 0")

    def _singles(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for name in self.counted:
            out |= {f"{name}_{n}": F.coalesce(c, F.lit(0)) for n, c in text_counters(F.coalesce(name, F.lit(""))).items()}
        return out

    @staticmethod
    def _scaled(name: str, scales: dict) -> Column:
        mean, deviation = scales[name, "mean"], scales[name, "deviation"]
        return (F.coalesce(F.col(name).cast("double"), F.lit(mean)) - mean) / (deviation or 1.0)

    def _by_row(self, df: DataFrame, key: str, known: list[_Known]) -> DataFrame:
        """As ``apply`` for rows with a key each: a row's vector is made where it lies."""
        singles = [c.cast("double") for c in self._singles(df).values()]
        if self.numbers:
            scales = {(r.name, r.term): r.value for r in self.table.where("part = 'scale'").collect()}
            singles = [*[self._scaled(n, scales) for n in self.numbers], *singles]
        numbers = T.ArrayType(T.DoubleType())
        schema = T.StructType([df.schema[key], T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", numbers), T.StructField("__s", numbers)])
        rows = df.select(key, F.array(*singles).cast(numbers).alias("__s"), *[vectoriser_tokens(F.col(t.name), t.stop_words).alias(f"__t{i}") for i, t in enumerate(self.texts)])
        out = rows.mapInArrow(lambda it: (b.rename_columns(schema.names) for b in _vectors(it, known)), schema)
        last = F.col("__s")
        if self.polarity is not None:
            lexicon = self._part("word", self.polarity).select(F.col("term").alias("word"), F.col("value").alias("polarity"))
            found = M.polarity(df.select(key, self.polarity), key, self.polarity, lexicon).withColumnRenamed("polarity", "__polarity")
            out = out.join(found, key, "left")
            last = F.array_append("__s", F.coalesce("__polarity", F.lit(0.0)) + self.shift)
        first = sum(t.max_features for t in self.texts)
        placed = F.transform(last, lambda v, i: F.struct((i + first).cast("int").alias("position"), v.alias("value")))
        out = out.withColumn("__s", F.filter(placed, lambda x: x["value"] != 0))
        return out.select(
            key,
            F.lit(self.size).alias("size"),
            F.concat("indices", F.col("__s")["position"]).alias("indices"),
            F.concat("values", F.col("__s")["value"]).alias("values"),
        )

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """``(key, size, indices, values)`` of every row, indices rising.

        Rows of one key are added up, which takes a shuffle of their cells.
        """
        # At most max_features rows a column.
        known = [_Known(t, self._part("term", t.name).collect()) for t in self.texts]
        if known and all(k.fits for k in known) and df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return self._by_row(df, key, known)
        cells = self.cells(df, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("__c"))
        empty = F.array()
        return df.select(key).join(cells, key, "left").select(
            key,
            F.lit(self.size).alias("size"),
            F.coalesce(F.col("__c")["position"], empty.cast("array<int>")).alias("indices"),
            F.coalesce(F.col("__c")["value"], empty.cast("array<double>")).alias("values"),
        )


def fit_features(
    df: DataFrame,
    key: str,
    texts: Sequence[TextColumn],
    numbers: Sequence[str] = (),
    counted: Sequence[str] = (),
    polarity: str | None = None,
    lexicon: DataFrame | None = None,
    shift: float = 0.0,
) -> Features:
    """Features of the rows of ``df``: terms, standardised numbers, text counters, mean polarity plus ``shift``.

    ``lexicon`` has ``(word, polarity)``; its words count for the column ``polarity``.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([], STATE)
    first = 0
    for column in texts:
        kept = _kept_terms(df, key, column)
        # At most max_features rows.
        place = (F.row_number().over(Window.orderBy("term")) - 1 + first).cast("int")
        table = table.unionByName(kept.select(F.lit("term").alias("part"), F.lit(column.name).alias("name"), "term", place.alias("position"), "value"))
        first += column.max_features
    for name in numbers:
        stats = df.agg(F.avg(name).alias("mean"), F.stddev_pop(name).alias("deviation"))
        rows = stats.select(F.inline(F.array(*[F.struct(F.lit(x).alias("term"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("value")) for x in ("mean", "deviation")])))
        table = table.unionByName(rows.select(F.lit("scale").alias("part"), F.lit(name).alias("name"), "term", F.lit(None).cast("int").alias("position"), "value"))
    if lexicon is not None:
        words = lexicon.select(F.lit("word").alias("part"), F.lit(polarity).alias("name"), F.col("word").alias("term"), F.lit(None).cast("int").alias("position"), F.col("polarity").cast("double").alias("value"))
        table = table.unionByName(words)
    size = first + len(numbers) + sum(len(text_counters(F.lit(""))) for _ in counted) + (polarity is not None)
    return Features(tuple(texts), tuple(numbers), tuple(counted), polarity, shift, materialize(table, "features"), size)


def as_vectors(df: DataFrame) -> DataFrame:
    """Stored ``x``, a sparse vector, in place of size, indices and values."""
    spark = df.sparkSession
    x = F.struct(F.lit(0).cast("byte").alias("type"), "size", "indices", "values")
    rest = [c for c in df.columns if c not in ("size", "indices", "values")]
    path = scratch_path(spark, "vectors")
    stored = df.select(*rest, x.alias("x"))
    stored.write.parquet(path)
    # A sparse vector is stored as just that struct.
    return spark.read.schema(T.StructType([*[df.schema[c] for c in rest], T.StructField("x", VectorUDT())])).parquet(path)


def train(df: DataFrame, label: str, kind: str = "logistic", **options) -> Callable[[DataFrame], DataFrame]:
    """Fit one of three classifiers on rows ``(label, x)``; gives ``rows -> rows with predicted``.

    logistic takes ``c`` (5) and ``iterations`` (1000), forest ``trees`` (100) and
    ``depth`` (20), bayes ``alpha`` (0.1). Labels are indexed in alphabetical order.
    """
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df)
    ready = index.transform(df).select("__y", "x")
    if kind == "logistic":
        # The summed loss times c against half the squared weights, as a mean over the rows.
        ridge = 1 / (options.pop("c", 5.0) * max(1, df.count()))
        model = LogisticRegression(maxIter=options.pop("iterations", 1000), regParam=ridge, standardization=False, labelCol="__y", featuresCol="x")
    elif kind == "forest":
        model = RandomForestClassifier(numTrees=options.pop("trees", 100), maxDepth=options.pop("depth", 20), seed=42, maxMemoryInMB=1024, cacheNodeIds=True, labelCol="__y", featuresCol="x")
    elif kind == "bayes":
        model = NaiveBayes(smoothing=options.pop("alpha", 0.1), labelCol="__y", featuresCol="x")
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    if options:
        raise ValueError(f"unknown options {sorted(options)}")
    fitted = model.fit(ready)
    names = F.array(*[F.lit(x) for x in index.labels])

    def predict(rows: DataFrame) -> DataFrame:
        out = fitted.transform(rows)
        return out.select(*rows.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"))

    return predict
