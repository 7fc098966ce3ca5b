"""Greedy segmentation in parallel.

A greedy packer restarts from nothing at each segment, so where a segment ends
depends only on where it starts. Every item therefore has one successor, and the
segments are the chain of successors from item 0. ``follow`` finds it without
walking a group:

* Items are dealt in chunks of consecutive numbers, one row a chunk.
* A successor given by a bound ("the first later item that ends beyond ...") is
  a next-greater search. Inside a chunk it goes down a table of maxima of 1, 2,
  4, ... items; beyond it, up and down a tree of chunk maxima (``FAN`` to a
  node), by joins on the node. Ends need not be in order.
* Inside a chunk, chains are followed by pointer doubling: all items at once,
  ``log2`` of the chunk's size steps.
* A chain leaves a chunk at an item whose successor lies beyond. Those exits
  form a graph of one edge each, whose part reached from the first item is
  found by pointer doubling over the exit table, ``log2`` of the number of
  chunks joins. Groups of one chunk need none of this.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

CHUNK_ITEMS = 1024
#: Children of a node in the tree of maxima.
FAN = 64


@dataclass(frozen=True)
class Extent:
    """The successor of an item is the first later one with ``end - start > limit``.

    With ``gap``, an item that starts more than ``gap`` after its neighbour's
    end is a successor of every item before it.
    """

    start: str
    end: str
    limit: float
    gap: float | None = None


def next_beyond(start: np.ndarray, value: np.ndarray, ends: np.ndarray, limit: float) -> np.ndarray:
    """For each item the first later one before ``ends`` with ``value - start > limit``, else ``ends``."""
    n = len(value)
    levels = [value]
    width = 1
    longest = int((ends - np.arange(n)).max(initial=0))
    while width < longest:
        last = levels[-1]
        more = last.copy()
        more[:-width] = np.fmax(last[:-width], last[width:])
        levels.append(more)
        width *= 2
    at = np.arange(1, n + 1)
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) <= ends
        block = levels[k][np.minimum(at, n - 1)]
        # A block that fits lies inside the chunk, so its maximum is of its own items.
        at = np.where(fits & ~(block - start > limit), at + (1 << k), at)
    return at


def last_of_chain(hop: np.ndarray) -> np.ndarray:
    """Where the chain from each item ends; an item that hops to itself is an end."""
    while True:
        further = hop[hop]
        if (further == hop).all():
            return hop
        hop = further


def on_chain(hop: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which items the chains from ``entries`` pass."""
    passed = np.zeros(len(hop), bool)
    passed[entries] = True
    while True:
        passed[hop[passed]] = True
        further = hop[hop]
        if (further == hop).all():
            return passed
        hop = further


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of a list column and the bounds of its rows."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _numbers(column: pa.Array, kind: type, missing) -> np.ndarray:
    return np.asarray(column.fill_null(missing).to_numpy(zero_copy_only=False), kind)


_STATE = "__hop array<int>, __last array<int>, __values array<double>, __top double"


def _prepare(batches: Iterator[pa.RecordBatch], keys: int, chunk: int, extent: Extent | None) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk where its items hop inside it (-1: beyond it), the last of their chains, and its largest end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        items, bounds = _flat(batch.column(keys + 1))
        c = batch.column(keys).to_numpy()
        fields = dict(zip(items.type.names, items.flatten(), strict=True))
        index = _numbers(fields["__i"], np.int64, 0)
        row = np.repeat(np.arange(len(c)), np.diff(bounds))
        own = index >= c[row] * chunk
        if extent is not None:
            start, value = _numbers(fields["__start"], np.float64, np.nan), _numbers(fields["__end"], np.float64, np.nan)
            if extent.gap is not None:
                opens = np.zeros(len(index), bool)
                opens[1:] = (start[1:] - value[:-1] > extent.gap) & (row[1:] == row[:-1])
                value = np.where(opens, np.inf, value)
            start, value = start[own], value[own]
        else:
            ahead = _numbers(fields["__next"], np.int64, np.iinfo(np.int64).max)[own]
        index, row = index[own], row[own]
        bounds = np.searchsorted(row, np.arange(len(c) + 1))
        here, ends = np.arange(len(row)), bounds[1:][row]
        if extent is not None:
            to = next_beyond(start, value, ends, extent.limit)
        else:
            to = np.minimum(here + np.clip(ahead - index, 1, chunk), ends)
        leaves = to >= ends
        hop = np.where(leaves, here, to)
        last = last_of_chain(hop)
        top = np.full(len(c), -np.inf)
        if extent is not None:
            np.fmax.at(top, row, value)
        places = pa.array(bounds, pa.int32())
        local = lambda x: pa.ListArray.from_arrays(places, pa.array((x - bounds[row]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[: keys + 1],
                pa.ListArray.from_arrays(places, items.filter(pa.array(own))),
                pa.ListArray.from_arrays(places, pa.array(np.where(leaves, -1, hop - bounds[row]).astype(np.int32))),
                local(last),
                pa.ListArray.from_arrays(places, pa.array(value)) if extent is not None else pa.nulls(len(c), pa.list_(pa.float64())),
                pa.array(top),
            ],
            names=[*batch.schema.names[: keys + 2], "__hop", "__last", "__values", "__top"],
        )


def _label(batches: Iterator[pa.RecordBatch], keys: int, chunk: int, names: list[str], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """Every item with the number of the item that opens its segment."""
    for batch in batches:
        if not batch.num_rows:
            continue
        items, bounds = _flat(batch.column(keys + 1))
        fields = dict(zip(items.type.names, items.flatten(), strict=True))
        c = batch.column(keys).to_numpy()
        row = np.repeat(np.arange(len(c)), np.diff(bounds))
        hop = _numbers(batch.column(keys + 2).flatten(), np.int64, 0)
        here = np.arange(len(row))
        hop = np.where(hop < 0, here, hop + bounds[row])
        entry = _numbers(batch.column("__entry"), np.int64, -1)
        entry = np.where(c == 0, 0, entry)
        some = (entry >= 0) & (np.diff(bounds) > 0)
        opens = on_chain(hop, (bounds[:-1] + entry)[some])
        index = _numbers(fields["__i"], np.int64, 0)
        # The last opening item at or before each; before a chunk's first, the one carried in.
        seen = np.maximum.accumulate(np.where(opens, here, -1)) if len(here) else here
        carried = _numbers(batch.column("__carry"), np.int64, 0)
        label = np.where(seen >= bounds[:-1][row], index[np.maximum(seen, 0)], carried[row])
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(at) for k in range(keys)), fields["__i"], *(fields[p] for p in payload), pa.array(label)],
            names=names,
        )


def _beyond(blocks: DataFrame, asked: DataFrame, keys: list[str], limit: float, highest: int, fan: int) -> DataFrame:
    """``(keys, q, found)``: the first block after ``after`` whose ``top`` lies more than ``limit`` past ``start``.

    ``blocks (keys, b, top)`` count 0, 1, 2, ...; ``asked (keys, q, start, after)``.
    Looked for among the siblings first, then among the parents, then down again.
    """
    nodes = blocks.withColumn("__node", F.floor(F.col("b") / fan)).groupBy(*keys, "__node").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("b", "top"))), lambda x: x["top"]).alias("__tops")
    )

    def first(after: Column) -> Column:
        over = F.transform(F.col("__tops"), lambda top, k: (k > after) & (top - F.col("start") > limit))
        return F.nullif(F.array_position(over, F.lit(True)), F.lit(0)) - 1

    placed = asked.withColumn("__node", F.floor(F.col("after") / fan)).join(nodes, [*keys, "__node"])
    near = placed.select(*keys, "q", "start", "__node", (F.col("__node") * fan + first(F.col("after") % fan)).alias("found"))
    if highest < fan:
        return near.select(*keys, "q", "found")
    near = materialize(near, "near-blocks")
    parents = blocks.groupBy(*keys, F.floor(F.col("b") / fan).alias("b")).agg(F.max("top").alias("top"))
    open_ = near.where("found IS NULL").select(*keys, "q", "start", F.col("__node").alias("after"))
    above = _beyond(parents, open_, keys, limit, highest // fan, fan).where("found IS NOT NULL")
    down = above.join(open_.select(*keys, "q", "start"), [*keys, "q"]).withColumnRenamed("found", "__node").join(nodes, [*keys, "__node"])
    far = down.select(*keys, "q", (F.col("__node") * fan + first(F.lit(-1))).alias("found"))
    return near.select(*keys, "q", F.col("found").alias("__near")).join(far, [*keys, "q"], "left").select(
        *keys, "q", F.coalesce("__near", "found").alias("found")
    )


def _exits(table: DataFrame, keys: list[str], chunk: int, extent: Extent | None, highest: int, fan: int) -> DataFrame:
    """``(keys, u, to, onward)``: items that leave their chunk, their successor, and the exit after that."""
    leaving = table.select(*keys, "__c", F.posexplode(F.arrays_zip("__x", "__hop")).alias("__p", "__z")).where("__z.__hop < 0")
    number = (F.col("__c") * chunk + F.col("__p")).alias("u")
    if extent is None:
        found = leaving.select(*keys, number, F.col("__z.__x.__next").alias("to"))
    else:
        asked = leaving.select(*keys, number.alias("q"), F.col("__z.__x.__start").alias("start"), F.col("__c").alias("after"))
        asked = materialize(asked, "open-ends")
        blocks = table.select(*keys, F.col("__c").alias("b"), F.col("__top").alias("top"))
        placed = _beyond(blocks, asked, keys, extent.limit, highest, fan)
        inside = placed.join(asked.drop("after"), [*keys, "q"]).withColumnRenamed("found", "__c")
        ends = table.select(*keys, "__c", "__values")
        hit = F.transform("__values", lambda e: e - F.col("start") > extent.limit)
        found = inside.join(ends, [*keys, "__c"], "left").select(
            *keys, F.col("q").alias("u"), (F.col("__c") * chunk + F.array_position(hit, F.lit(True)) - 1).alias("to")
        )
    onward = table.select(*keys, "__c", "__last")
    size = F.size("__last")
    at = F.col("to") - F.col("__c") * chunk
    return (
        found.withColumn("__c", F.floor(F.col("to") / chunk))
        .join(onward, [*keys, "__c"], "left")
        .select(
            *keys,
            "u",
            F.when(at < size, F.col("to")).alias("to"),
            F.when(at < size, F.col("__c") * chunk + F.get("__last", at.cast("int"))).alias("onward"),
        )
    )


def _entries(table: DataFrame, keys: list[str], chunk: int, extent: Extent | None, highest: int, fan: int) -> DataFrame:
    """``(keys, __c, __entry, __carry)``: where the chain enters each chunk, and the opening item that lasts until then."""
    exits = materialize(_exits(table, keys, chunk, extent, highest, fan), "exits")
    first = table.where("__c = 0").select(*keys, F.get("__last", F.lit(0)).cast("long").alias("u"), F.lit(True).alias("__live"))
    jumps = exits.select(*keys, "u", F.col("onward").alias("j")).join(first, [*keys, "u"], "left")
    jumps = jumps.withColumn("__live", F.coalesce("__live", F.lit(False)))
    for _ in range(max(1, highest).bit_length()):
        jumps = materialize(jumps, "jumps")
        reached = jumps.where("__live AND j IS NOT NULL").select(*keys, F.col("j").alias("u"), F.lit(True).alias("__hit")).distinct()
        further = jumps.select(*keys, F.col("u").alias("j"), F.col("j").alias("__j2"))
        jumps = (
            jumps.join(further, [*keys, "j"], "left")
            .join(reached, [*keys, "u"], "left")
            .select(*keys, "u", F.col("__j2").alias("j"), (F.col("__live") | F.coalesce("__hit", F.lit(False))).alias("__live"))
        )
    live = exits.join(jumps.where("__live").select(*keys, "u"), [*keys, "u"])
    ends = table.groupBy(*keys).agg(F.max("__c").alias("__end"))
    into = F.floor(F.col("to") / chunk)
    spans = live.join(ends, keys).withColumn("__from", F.floor(F.col("u") / chunk) + 1).withColumn("__to", F.coalesce(into, "__end"))
    return (
        spans.where("__from <= __to")
        .select(*keys, "u", "to", F.explode(F.sequence("__from", "__to")).alias("__c"))
        .select(
            *keys,
            "__c",
            F.when(F.col("__c") == into, F.col("to") - into * chunk).alias("__entry"),
            F.col("u").alias("__carry"),
        )
    )


def follow(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    successor: Extent | str,
    out: str,
    payload: Sequence[str] = (),
    chunk: int = CHUNK_ITEMS,
    fan: int = FAN,
) -> DataFrame:
    """``(keys, index, payload, out)``: for each item the number of the item that opens its segment.

    ``index`` counts 0, 1, 2, ... within ``keys``, which are not null.
    ``successor`` is an ``Extent``, or the column with the number at which the
    next segment would start (null or past the end: none).
    """
    keys, payload = list(keys), list(payload)
    extent = successor if isinstance(successor, Extent) else None
    types = {f.name: f.dataType for f in df.schema}
    number = F.floor(F.col(index) / chunk)
    fields = [F.col(index).cast("long").alias("__i"), *payload]
    chunks = F.array(number)
    if extent is None:
        fields.append(F.col(successor).cast("long").alias("__next"))
    else:
        fields += [F.col(extent.start).cast("double").alias("__start"), F.col(extent.end).cast("double").alias("__end")]
        if extent.gap is not None:
            # The first item of a chunk is compared with the last of the chunk before.
            chunks = F.when(F.col(index) % chunk == chunk - 1, F.array(number, number + 1)).otherwise(chunks)
    dealt = df.select(*keys, F.explode(chunks).alias("__c"), F.struct(*fields).alias("__x"))
    rows = dealt.groupBy(*keys, "__c").agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    rows = rows.where(F.element_at("__x", -1)["__i"] >= F.col("__c") * chunk)
    width = len(keys)
    state = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(_STATE).fields])
    table = materialize(rows.mapInArrow(lambda it: _prepare(it, width, chunk, extent), state), "chunks")
    highest = table.agg(F.max("__c")).first()[0] or 0
    if highest:
        entered = table.join(_entries(table, keys, chunk, extent, highest, fan), [*keys, "__c"], "left")
    else:
        entered = table.withColumns({"__entry": F.lit(None).cast("long"), "__carry": F.lit(None).cast("long")})
    names = [*keys, index, *payload, out]
    schema = T.StructType(
        [*(T.StructField(k, types[k]) for k in keys), T.StructField(index, T.LongType()), *(T.StructField(p, types[p]) for p in payload), T.StructField(out, T.LongType())]
    )
    entered = entered.select(*keys, "__c", "__x", "__hop", "__entry", "__carry")
    return entered.mapInArrow(lambda it: _label(it, width, chunk, names, payload), schema)


def mark_starts(df: DataFrame, keys: Sequence[str], index: str, following: str, out: str, chunk: int = CHUNK_ITEMS) -> DataFrame:
    """``(keys, index, out)``: whether each item starts a segment; see ``follow``."""
    found = follow(df, keys, index, following, "__opens", chunk=chunk)
    return found.select(*keys, index, (F.col("__opens") == F.col(index)).alias(out))
