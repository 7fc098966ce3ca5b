"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; a null or empty text has none. Each has a
digest of 40 bits, and each digest goes into one cell of each of three rows of
``CELLS / 3`` cells. A cell holds a count, the sum of its digests and the sum of
their check values, so equal paragraphs add up and order doesn't matter. The
sketches of two versions subtract cell by cell; what is left is peeled: a cell
whose sums are those of one digest gives it away, which frees further cells.
What differs between the versions comes out as digests with multiplicities.

Where peeling ends with cells left, the pair is sketched again in more blocks (a
digest's block is part of its bits), first as many as the paragraph counts ask
for, then doubling. A pair that ``RETRIES`` doublings don't solve is compared
digest by digest, so every likeness is that of the full difference.

Everything is DataFrame functions: texts are shuffled once, to chunks of
neighbouring ids whose bounds are percentiles, and only the digests are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import remove, saved

CELLS = 24
PER_BLOCK = 7
RETRIES = 4
ROUNDS = 6
CHUNK_DOCS = 256
MOST_CHUNKS = 1 << 16


def digests(text: Column) -> Column:
    """Digests of a text's paragraphs, 40 bits each."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.shiftrightunsigned(F.xxhash64(x), 24))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(lines)


def _cells(digest: Column, blocks: Column) -> list[Column]:
    """The digest's cell in each of the three rows of its block."""
    wide = CELLS // 3
    block = F.shiftright(digest, 9) % blocks * CELLS
    return [block + F.shiftright(digest, 3 * row).bitwiseAND(wide - 1) + row * wide for row in range(3)]


def sketch(items: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Cells of ``items (keys, d, blocks)``: per cell the sums of counts ``sums``.

    A count ``x`` gives ``x_c``, ``x_k`` and ``x_h``: count, sum of digests, sum of
    check values. A signed count sketches a difference.
    """
    spread = items.withColumn("h", F.shiftrightunsigned(F.xxhash64("d"), 33)).withColumn(
        "cell", F.explode(F.array(*_cells(F.col("d"), F.col("blocks"))))
    )
    totals = []
    for name, count in sums.items():
        count = count.cast("bigint")
        totals += [F.sum(count).alias(f"{name}_c"), F.sum(count * F.col("d")).alias(f"{name}_k"), F.sum(count * F.col("h")).alias(f"{name}_h")]
    return spread.groupBy(*keys, "blocks", "cell").agg(*totals)


def peel(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ok, differ)`` of difference sketches ``(keys, blocks, cell, c, k, h)``.

    A round takes every pure cell at once: its content is taken from the three
    cells of its digest (once, though several may name it) and counted in cell
    -1. Rounds need no shuffle where ``keys`` is how the rows are dealt. What
    ``ROUNDS`` rounds don't empty has failed.
    """
    keys = [*keys, "blocks"]
    for _ in range(ROUNDS):
        d = F.when((F.col("cell") >= 0) & (F.col("c") != 0), F.expr("CASE WHEN c <> 0 THEN k div c END"))
        marked = cells.withColumn("x", d)
        own = _cells(F.col("x"), F.col("blocks"))
        pure = (
            (F.col("x") >= 0)
            & (F.col("x") * F.col("c") == F.col("k"))
            & (F.shiftrightunsigned(F.xxhash64("x"), 33) * F.col("c") == F.col("h"))
            & F.col("cell").isin(*own)
        )

        def row(cell: Column, x: Column, c: Column, k: Column, h: Column) -> Column:
            names = {"cell": cell, "x": x, "c": c, "k": k, "h": h}
            return F.struct(*[v.cast("bigint").alias(n) for n, v in names.items()])

        c, k, h, x, none = F.col("c"), F.col("k"), F.col("h"), F.col("x"), F.lit(None)
        stay = row(F.col("cell"), none, c, k, h)
        take = [row(cell, x, -c, -k, -h) for cell in own]
        note = row(F.lit(-1), x, F.abs(c), F.lit(0), F.lit(0))
        rows = F.when(F.coalesce(pure, F.lit(False)), F.array(stay, *take, note)).otherwise(F.array(stay))
        moved = marked.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
        once = moved.groupBy(*keys, "cell", "x").agg(*[F.max(n).alias(n) for n in "ckh"])
        cells = once.groupBy(*keys, "cell").agg(*[F.sum(n).alias(n) for n in "ckh"]).filter("c <> 0 OR k <> 0 OR h <> 0")
    noted = F.col("cell") < 0
    return cells.groupBy(*keys).agg(
        F.bool_and(noted).alias("ok"), F.coalesce(F.sum(F.when(noted, F.col("c"))), F.lit(0)).alias("differ")
    )


def _as_text(cells: Column) -> Column:
    """The cells in use as hexadecimal text: place, count, digests, checks."""
    shown = lambda x: F.concat_ws(".", *[F.hex(x.getField(i)) for i in ("cell", "c", "k", "h")])
    return F.array_join(F.transform(cells.cast("array<struct<cell:bigint,c:bigint,k:bigint,h:bigint>>"), shown), "-")


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    """Shared paragraphs over all of both versions; 1 for two empty ones."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - differ) / (n_a + n_b + differ))


def _search(value: Column, bounds: list[int]) -> Column:
    """Number of sorted ``bounds`` at or below ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    padded = F.lit(bounds)

    def half(low: Column, jump: Column) -> Column:
        to = low + jump
        return F.when((to <= len(bounds)) & (F.get(padded, to - 1) <= value), to).otherwise(low)

    return F.aggregate(F.lit([1 << i for i in reversed(range(steps))]), F.lit(0), half)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text, next_text)``: every text beside that of the next higher id.

    After the last comes the first. Ids are cut at percentiles into chunks; the
    first document of each chunk is also sent, as a guest, to the chunk before.
    Null ids come first; of equal ids the greater text comes later.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    n = rows.count()
    chunks = max(1, min(MOST_CHUNKS, n // CHUNK_DOCS))
    bounds: list[int] = []
    if chunks > 1:
        cuts = rows.agg(F.percentile_approx(rank, [i / chunks for i in range(1, chunks)], 10 * chunks)).first()[0]
        bounds = sorted(set(cuts))
    dealt = rows.select("doc_id", "text", rank.alias("rank")).withColumn("chunk", _search(F.col("rank"), bounds))
    firsts = {r["chunk"]: r["rank"] for r in dealt.groupBy("chunk").agg(F.min("rank").alias("rank")).collect()}
    order = sorted(firsts)
    before = dict(zip(order[1:], order, strict=False))
    guests = F.lit(None).cast("int")
    if before:
        leaders = [firsts[c] for c in order[1:]]
        back = F.map_from_arrays(F.lit([*before]), F.lit([*before.values()]))
        guests = F.when(F.col("rank").isin(leaders), F.element_at(back, F.col("chunk")))
    wrap = F.when(F.col("rank") == (firsts[order[0]] if order else 0), F.lit(order[-1] if order else 0))
    homes = F.array(
        F.struct(F.col("chunk").alias("to"), F.lit(0).alias("guest")),
        F.struct(guests.alias("to"), F.lit(1).alias("guest")),
        F.struct(wrap.alias("to"), F.lit(2).alias("guest")),
    )
    homes = F.filter(homes, lambda x: x["to"].isNotNull())
    sent = dealt.select("doc_id", "text", "rank", F.explode(homes).alias("home")).select(
        "doc_id", "text", "rank", F.col("home.to").alias("chunk"), F.col("home.guest").alias("guest")
    )
    beside = Window.partitionBy("chunk").orderBy("guest", "rank", "text")
    return sent.withColumn("next_text", F.lead("text").over(beside)).filter("guest = 0").select("doc_id", "text", "next_text")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document, its edited text and the next document, by their sketches.

    The edited text has its last ``floor(n / 2)`` code points replaced by the
    first as many (or all) of the next document. Rows with equal ids are
    answered each.
    """
    spark = docs.sparkSession
    folders: list[str] = []
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    base = with_next(docs, key, text).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(edited).alias("new"),
        digests(F.col("next_text")).alias("next"),
    )
    base = saved(base.withColumn("row", F.monotonically_increasing_id()), "digests", folders).repartition("row")
    sizes = F.struct(*[F.size(v).cast("bigint").alias(v) for v in ("own", "new", "next")]).alias("n")

    def flagged(version: str) -> Column:
        flags = [F.lit(int(version == o)).alias(o) for o in ("own", "new", "next")]
        return F.transform(version, lambda d: F.struct(d.alias("d"), *flags))

    versions = [flagged(v) for v in ("own", "new", "next")]
    items = base.select("row", F.lit(1).cast("bigint").alias("blocks"), F.explode(F.concat(*versions)).alias("i")).select("row", "blocks", "i.*")
    cells = sketch(items, ["row"], {v: F.col(v) for v in ("own", "new", "next")})
    listed = {
        v: F.array_sort(F.collect_list(F.when(F.col(f"{v}_c") > 0, F.struct("cell", f"{v}_c", f"{v}_k", f"{v}_h")))) for v in ("own", "new")
    }
    prints = cells.groupBy("row").agg(*[_as_text(x).alias(v) for v, x in listed.items()])

    other = {"edit": "new", "next": "next"}
    pair = [
        F.struct(F.lit(p).alias("pair"), *[(F.col(f"own_{x}") - F.col(f"{v}_{x}")).alias(x) for x in "ckh"]) for p, v in other.items()
    ]
    differences = cells.select("row", "blocks", "cell", F.explode(F.array(*pair)).alias("p")).select("row", "blocks", "cell", "p.*")
    differences = differences.filter("c <> 0 OR k <> 0 OR h <> 0")
    tried = saved(peel(differences, ["row", "pair"]), "peeled", folders)
    solved = tried.filter("ok").select("row", "pair", "differ")
    left = tried.filter("NOT ok").select("row", "pair")

    def signed(pairs: DataFrame) -> DataFrame:
        """``(row, pair, n, d, sign)``: the digests of both versions of each pair."""
        b = F.when(F.col("pair") == "edit", F.col("new")).otherwise(F.col("next"))
        sides = F.concat(
            F.transform("own", lambda d: F.struct(d.alias("d"), F.lit(1).alias("sign"))),
            F.transform(b, lambda d: F.struct(d.alias("d"), F.lit(-1).alias("sign"))),
        )
        rows = base.join(pairs, "row").select("row", "pair", F.size(sides).alias("n"), F.explode(sides).alias("s"))
        return rows.select("row", "pair", "n", "s.*")

    for turn in range(RETRIES):
        if left.isEmpty():
            break
        blocks = F.greatest(F.lit(2), F.ceil(F.col("n") / PER_BLOCK)).cast("bigint") * 2**turn
        larger = sketch(signed(left).withColumn("blocks", blocks), ["row", "pair"], {"s": F.col("sign")})
        larger = larger.select("row", "pair", "blocks", "cell", *[F.col(f"s_{x}").alias(x) for x in "ckh"]).filter("c <> 0 OR k <> 0 OR h <> 0")
        tried = saved(peel(larger, ["row", "pair"]), "peeled", folders)
        solved = solved.unionByName(tried.filter("ok").select("row", "pair", "differ"))
        left = tried.filter("NOT ok").select("row", "pair")
    plain = signed(left).groupBy("row", "pair", "d").agg(F.abs(F.sum("sign")).alias("c")).groupBy("row", "pair").agg(F.sum("c").alias("differ"))
    solved = solved.unionByName(plain).groupBy("row").pivot("pair", [*other]).agg(F.max("differ"))
    rows = base.select("row", "doc_id", "n_chars", "edited_sha256", sizes).join(solved, "row", "left")
    rows = rows.join(prints.withColumnsRenamed({"own": "own_print", "new": "new_print"}), "row", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat_ws("|", "n.own", F.coalesce("own_print", F.lit(""))).alias("fingerprint"),
        F.concat_ws("|", "n.new", F.coalesce("new_print", F.lit(""))).alias("edited_fingerprint"),
        likeness(F.col("n.own"), F.col("n.new"), F.coalesce("edit", F.lit(0))).alias("near_edited"),
        likeness(F.col("n.own"), F.col("n.next"), F.coalesce("next", F.lit(0))).alias("near_next"),
        F.col("n.own").alias("n_paragraphs"),
    )
    rows = saved(rows, "fingerprints")
    remove(spark, folders)
    return rows
