"""N-gram Jaccard join over parts that linked sets must have alike, exact for any group size.

A document's set is its distinct word shingles (hashes of 64 bits). Documents
with equal sets are one node, named by a 64-bit sum of the set. Two sets link
when ``percent`` of their union lies in their intersection.

*Parts.* Sets are dealt to bands by their sizes, so that linked sets are in the
same band or in neighbouring ones. For both cases the sizes bound by how many
shingles linked sets differ. The range of hashes is cut into more parts than
that, so at least one part is the same in both sets; the content of a part is a
key. A key stands for several shingles, so few unlike texts share one.

*Light parts* have less than ``content`` shingles (two, or one where parts are too
small for that) and would be keys of many
unlike texts. They are lengthened, to the end of the first following part (after
the last comes the first) that makes up ``content``. A differing shingle can so
spoil its own part and the light parts lengthened over it, and each of these is
light in both sets: with ``s`` parts in reserve, a common key is left whenever
one of the sets has at most ``s`` light parts. The reserve of a band is as many as
its smallest sets may be expected to have light. Sets with more light parts all the
same, as some of few shingles, also give the shingles of their prefix, the least so many that
two linked sets have one of them in common; no key stands for an empty part.

*Meeting.* Keys travel in blocks of bytes, one per slice and share of the key
range, a node's once per task. A share gives back the keys that several nodes
have; all else never becomes a row.

*Groups.* The nodes of a key are not compared pair by pair. In each round a few
nodes of each group, the hubs, are compared with the others that are not yet in
their component, and leave the group; groups within one component end. There are
few hubs in the first round, when copies fall together, then more (``HUBS``).
Pairs that sizes or parities rule out are never verified.
Only links that a known path already implies are skipped, so components are
exact. Keys with the same nodes are one group.

Null and empty texts have no set, no node and no links. Documents with fewer
words than a shingle have their whole sequence as their one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import components, remove, saved
from .words import find_words, mix, seeds, shingles, short_sequence, slices, text_bytes

SHARES = 1024
BLOCK = 1 << 20
HUBS = (8, 512)
PARITY_WORDS = 16
NONE = np.zeros(0, np.uint64)

_NODE, _MEMBER, _BAND, _SINGLE = seeds(4, 4000)
# Filled in each process as sizes come up; functools.cache doesn't travel to executors without the package.
_BORDERS: dict[int, np.ndarray] = {}
_PARTS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int, int]] = {}


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = find_words(*text_bytes(column))
    hashes, first = shingles(words, size)
    cuts = np.searchsorted(words.doc[first] if len(first) else first, np.arange(len(column) + 1))
    sets = []
    for i, n in enumerate(words.per_doc):
        if 0 < n < size:
            sets.append(np.array([short_sequence(words, i)], np.uint64))
        else:
            sets.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
    return sets


def node_of(members: np.ndarray) -> int:
    return int((mix(members ^ _NODE).sum(dtype=np.uint64)).astype(np.int64))


def parities(members: np.ndarray) -> np.ndarray:
    """For each of 64 ``PARITY_WORDS`` classes of hashes whether the set has an odd number of them, as bits.

    Classes in which two sets differ hold a hash that only one of them has, so
    the differing bits are at most the symmetric difference.
    """
    classes = 64 * PARITY_WORDS
    odd = np.bincount((members >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def borders(percent: int) -> np.ndarray:
    """Least size of each band: linked sets are in one band or in neighbouring ones."""
    if percent in _BORDERS:
        return _BORDERS[percent]
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * 100 // percent + 1)
    return _BORDERS.setdefault(percent, np.array(least))


def reserve(least: int, differ: int) -> tuple[int, int]:
    """How many parts are in reserve, and the content of a part that isn't light.

    Two if a quarter of the parts in reserve, and a few, can be as many as are light, else one.
    """

    def short(spare: int, content: int) -> float:
        """Light parts of a set of ``least`` shingles, two deviations above the mean, beyond the reserve."""
        n = differ + 1 + spare
        light = (1 - 1 / n) ** least
        if content > 1:
            light += least / n * (1 - 1 / n) ** (least - 1)
        return n * light + 2 * (n * light * (1 - light)) ** 0.5 - spare

    for content, most in ((2, 4 + differ // 4), (1, 4 + differ // 2)):
        # What is short falls, then rises again.
        at = np.unique(np.linspace(0, most, 200).astype(int)).tolist()
        enough = [x for x in at if short(x, content) <= 0]
        if enough:
            return enough[0], content
    return min(at, key=lambda x: short(x, 1)), 1


def parts(band: int, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of links whose smaller set is in ``band``: each part's least hash and seed, how many parts are in reserve, their content."""
    if (band, percent) in _PARTS:
        return _PARTS[band, percent]
    least, most = int(borders(percent)[band]), int(borders(percent)[band + 1]) - 1
    differ = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
    spare, content = reserve(least, differ)
    at = np.arange(differ + 1 + spare, dtype=np.uint64)
    start = (at << np.uint64(32)) // np.uint64(len(at)) << np.uint64(32)
    return _PARTS.setdefault((band, percent), (start, mix(at + (np.uint64(band) << np.uint64(40)) ^ _BAND), spare, content))


def prefix_keys(members: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set, its parts as of the smaller and of the larger set of a link.

    Shingles in ``frequent`` (sorted) do not count as content of a part.
    """
    n = len(members)
    if percent >= 100:
        return NONE
    # Places from 0 to 2 n, as windows may run on from the last part to the first.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.tile(mix(members ^ _MEMBER), 2), dtype=np.uint64)))
    counts, rare = np.arange(2 * n + 1), np.ones(n, bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] != members
        counts = np.concatenate(([0], np.cumsum(np.tile(rare, 2))))
    band = int(np.searchsorted(borders(percent), n, side="right")) - 1
    keys, few = [], False
    for lower in range(max(band - 1, 0), band + 1):
        least, own, spare, content = parts(lower, percent)
        start = np.searchsorted(members, least)
        end = np.append(start[1:], n)
        light = counts[end] - counts[start] < content
        last = end
        if light.any():
            ends = np.concatenate((end, end + n))
            full = np.searchsorted(counts[ends], counts[start] + content)
            last = np.minimum(ends[np.clip(full, np.arange(len(end)), len(ends) - 1)], start + n)
        keys.append(mix(sums[last] - sums[start] + own))
        few |= light.sum() > spare
    if few:
        # Linked sets have percent of either in common, so not all of these can be missing; rare ones come first.
        prefix = np.concatenate((members[rare], members[~rare]))[: n - -(-percent * n // 100) + 1]
        keys.append(mix(prefix ^ _SINGLE))
    return np.concatenate(keys)


def set_table(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(doc_id, node, n, odd)`` of every document; node is null for empty sets."""

    def run(batches):
        for part in slices(batches, "_text"):
            sets = shingle_sets(part.column("_text"), size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(
                        np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS,
                        pa.array(np.concatenate([parities(s) for s in sets])),
                    ),
                ],
                names=["doc_id", "node", "n", "odd"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, node long, n long, odd array<long>")


def _blocks(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    """``(share, keys, nodes)``: one row for each share of the key range."""
    flat = np.concatenate(keys)
    share = (flat >> np.uint64(32)) * np.uint64(SHARES) >> np.uint64(32)
    order = np.argsort(share, kind="stable")
    found, first = np.unique(share[order], return_index=True)
    ends = pa.py_buffer((np.append(first, len(flat)) * 8).astype(np.int32))
    bodies = (flat[order], np.concatenate(nodes)[order])
    columns = [pa.Array.from_buffers(pa.binary(), len(found), [None, ends, pa.py_buffer(b)]) for b in bodies]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *columns], names=["share", "keys", "nodes"])


def key_groups(docs: DataFrame, text: str, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``(key, node)`` of the keys that several nodes have."""

    def send(batches):
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for part in slices(batches, text):
            for members in shingle_sets(part.column(text), size):
                node = node_of(members) if len(members) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                keys.append(prefix_keys(members, frequent, percent))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                held += len(keys[-1])
                if held >= BLOCK:
                    yield _blocks(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield _blocks(keys, nodes)

    def meet(table: pa.Table) -> pa.Table:
        keys, nodes = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "nodes"))
        order = np.argsort(keys, kind="stable")
        order = order[_alike(keys[order])]
        order = order[np.lexsort((nodes[order], keys[order]))]
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        several = _alike(keys)
        return pa.table({"key": keys[several], "node": nodes[several]})

    sent = docs.select(text).mapInArrow(send, "share int, keys binary, nodes binary")
    return sent.groupBy("share").applyInArrow(meet, "key long, node long")


def _alike(sorted_keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys whether a neighbour equals it."""
    same = np.zeros(len(sorted_keys) + 1, bool)
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    return same[1:] | same[:-1]


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b, linked)`` by the exact Jaccard similarity of ``pairs (a, b)``.

    The text of ``b`` travels to ``a``; that of a hub is joined there once.
    """
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, held = None, None
        for part in slices(batches, "text_b", 2 << 20):
            sets_b = shingle_sets(part.column("text_b"), size)
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            linked = []
            for i, other in enumerate(sets_b):
                if a[i] != last:
                    last, held = a[i], shingle_sets(part.column("text_a").slice(i, 1), size)[0]
                both = len(held) + len(other)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                linked.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _unlike(groups: DataFrame, folders: list[str]) -> DataFrame:
    """One key of all keys that have the same nodes."""
    marks = groups.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.min("node").alias("lo"),
    )
    kept = marks.groupBy("m", "x", "y", "lo").agg(F.min("key").alias("key")).select("key")
    return saved(groups.join(kept, "key", "left_semi"), "groups", folders)


def link(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, frequent: np.ndarray = NONE
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document.

    ``component_id`` is the smallest id reachable over links, the document's own
    if there are none. Keys must be unique integers; rows with a null key are
    components of their own. ``frequent``: sorted hashes of shingles, as of a
    licence, that alone make no key where that can be avoided.
    """
    spark = docs.sparkSession
    folders: list[str] = []
    table = saved(set_table(docs, key, text, size), "sets", folders)
    ids = table.select("doc_id", "node", F.col("n").alias("n_shingles"))
    groups = _unlike(saved(key_groups(docs, text, size, percent, frequent), "groups", folders), folders)
    # The parities of the nodes in groups only; a node's documents have the same.
    odd = table.select("node", "n", *[F.col("odd")[i].alias(f"o{i}") for i in range(PARITY_WORDS)])
    odd = odd.groupBy("node").agg(F.max("n").alias("n"), *[F.max(f"o{i}").alias(f"o{i}") for i in range(PARITY_WORDS)])
    groups = saved(groups.join(odd, "node"), "groups", folders)
    columns = ["key", "node", "n", *[f"o{i}" for i in range(PARITY_WORDS)]]
    first = ids.groupBy("node").agg(F.min("doc_id").alias("_id"))
    wanted = groups.select("node").distinct().join(first, "node").select("node", "_id")
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text")).join(wanted, "_id").select("node", "text")
    texts = saved(texts, "texts", folders)

    checked, component = spark.createDataFrame([], "a long, b long, linked boolean"), None
    spent: list[str] = []
    turn = known_links = 0
    while not groups.isEmpty():
        known = groups.withColumn("c", F.col("node"))
        if component is not None:
            known = groups.join(component.withColumnRenamed("id", "node"), "node", "left").select(
                *columns, F.coalesce("component", "node").alias("c")
            )
        mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        open_rows = saved(known.join(mixed, "key").withColumn("h", F.xxhash64("node")), "open", spent)
        # The bound on the rank holds before the shuffle: a group sends that many rows from a task.
        order = Window.partitionBy("key").orderBy("h", "node")
        hubs = open_rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= HUBS[min(turn, len(HUBS) - 1)])
        hubs = saved(hubs.select("key", F.struct("h", "c", *columns[1:]).alias("hub")), "hubs", spent)
        # Bounds that no link breaks: on the sizes, and on what the sets don't share.
        differ = " + ".join(f"bit_count(o{i} ^ hub.o{i})" for i in range(PARITY_WORDS))
        alike = (
            f"c <> hub.c AND 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n) "
            f"AND ({differ}) * {100 + percent} <= {100 - percent} * (n + hub.n)"
        )
        later = "h > hub.h OR h = hub.h AND node > hub.node"
        pairs = open_rows.join(hubs, "key").filter(alike).filter(later)
        pairs = pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        fresh = pairs.join(checked, ["a", "b"], "left_anti") if turn else pairs
        checked = checked.unionByName(saved(verify(fresh, texts, size, percent), "checked", folders))
        links = checked.filter("linked").select("a", "b")
        now = links.count()
        if now > known_links:
            component, known_links = components(links, folders), now
        used = hubs.select("key", F.col("hub.node").alias("node"))
        groups = saved(open_rows.join(used, ["key", "node"], "left_anti").select(columns), "groups", folders)
        remove(spark, spent)
        turn += 1

    rooted = ids.withColumn("root", F.col("node"))
    if component is not None:
        rooted = ids.join(component.withColumnRenamed("id", "node"), "node", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "node").alias("root")
        )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    whole = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    result = saved(rooted.join(least, "root", "left").select("doc_id", "n_shingles", whole.alias("component_id")), "linked")
    remove(spark, folders)
    return result
