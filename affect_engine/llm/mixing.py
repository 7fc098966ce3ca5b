"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: the documents the mix should hold of it
over the documents there are. A document's uniform number comes from the hash
of its key and the seed, and the Poisson distribution with that mean is inverted
at it, so a run can be repeated and any document's count is known without the
others. Copies are exploded and the whole mix is put in an order given by the
hash of key, copy and seed.

The count per source is the only aggregate (one row a source). The mix is ranged
by the order's hash: no source or document can fill a partition. Null sources
are a source of their own; sources without a target weight are left out, and
targets without documents have no effect. Rows with equal keys get equal counts.
A rate above 500, where inversion would underflow, is the sum of equal smaller ones,
each with a number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

HEX_DIGITS = 13
MOST_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def poisson(rate: Column, u: Column) -> Column:
    """The least k with ``u`` below the Poisson distribution function at k, for rates up to ``MOST_RATE``.

    The sum runs term by term and stops adding once it has passed ``u``.
    """
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("total")
    )

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * rate / k
        return F.when(u < s["total"], s).otherwise(
            F.struct(k.cast("int").alias("k"), term.alias("term"), (s["total"] + term).alias("total"))
        )

    most = (rate + 12 * F.sqrt(rate) + 20).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def repeats(rate: Column, key: Column, seed: int) -> Column:
    """Poisson number of a document with any mean; above ``MOST_RATE`` a sum of independent ones."""
    parts = F.ceil(rate / MOST_RATE).cast("int")
    many = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda s, i: s + poisson(rate / parts, uniform(key, F.lit(seed), i, F.lit("part"))),
    )
    return F.when(parts > 1, many).otherwise(poisson(rate, uniform(key, F.lit(seed))))


def rates(docs: DataFrame, targets: DataFrame, total: float | None = None, source: str = "source") -> DataFrame:
    """``(source, rate)``: mean repetitions that bring each source to its target.

    ``targets (source, weight)`` need not sum to one. ``total`` is the size of
    the mix in documents; by default that of ``docs``.
    """
    sizes = docs.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = targets.filter("weight > 0").select(F.col("source").alias("_t"), F.col("weight").alias("_w"))
    everything = sizes.agg(F.sum("_n").alias("_all"))
    weight = wanted.agg(F.sum("_w").alias("_sum"))
    return (
        sizes.join(wanted, F.col("_s").eqNullSafe(F.col("_t")))
        .crossJoin(everything)
        .crossJoin(weight)
        .select(
            F.col("_s").alias("source"),
            (F.col("_w") / F.col("_sum") * (F.lit(total) if total else F.col("_all")) / F.col("_n")).alias("rate"),
        )
    )


def mix(
    docs: DataFrame,
    rate: DataFrame,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    copy: str = "copy_no",
    order: str = "mix_order",
) -> DataFrame:
    """``docs`` repeated by its source's rate, ordered by ``order``.

    Adds the copy's number from 0 and the ordering number. ``rate (source,
    rate)`` has one row a source.
    """
    copy, order = free_name(docs.columns, copy), free_name(docs.columns, order)
    of, own, many = (free_name(docs.columns, name) for name in ("_of", "_rate", "_copies"))
    r = rate.select(F.col("source").alias(of), F.col("rate").alias(own))
    known = docs.join(r, F.col(source).eqNullSafe(F.col(of)))
    copies = known.withColumn(many, repeats(F.col(own), F.col(key), seed)).filter(F.col(many) > 0)
    copies = copies.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias(copy))
    placed = copies.withColumn(order, uniform(F.col(key), F.col(copy), F.lit(seed), F.lit("order")))
    return placed.repartitionByRange(order, key, copy).sortWithinPartitions(order, key, copy)
