"""Line dedup by distinct-site spread, with DataFrame functions only.

A line that many sites share while little else of their documents agrees is
boilerplate. Per line hash, sites are counted by HyperLogLog sketches that merge
by aggregation. Where the estimate is too close to the threshold to decide, the
sites of that line are counted exactly; the result is the exact one.

Two things keep copied documents from looking like boilerplate. Texts that are
equal count once, by their smallest id. And occurrences are first reduced to one
per (line, context), the context being the longest other line of the document
(of several, the greatest in byte order):
copies with small edits share it, independent documents don't. A line is
boilerplate when its sites reach ``min_sites`` and its contexts are at least
``min_contexts`` of its documents.

Lines are split at \\n and compared as they are; blank lines are kept and never
counted. Null texts stay null, empty texts stay empty, a null site is a site of
its own. A text keeps its other lines as they were; one whose lines all go
becomes empty, and its row stays.

Hot lines: the first aggregate has the context in its key, the second merges
partial sketches before the shuffle, and the list of boilerplate lines joins the
occurrences as a small table, or as a join whose skew Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

MIN_SITES = 10
MIN_CONTEXTS = 0.5
LG_CONFIG = 11


def _is_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\t\r]", " ")) != ""


def line_keys(line: Column) -> list[Column]:
    """Two independent hashes; together 96 bits."""
    return [F.xxhash64(line).alias("_h1"), F.hash(line).alias("_h2")]


def occurrences(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """``(_key, _site, _h1, _h2, _ctx, _pos)``: the lines of each distinct text."""
    base = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(site).cast("string"), F.lit("\0null")).alias("_site"),
        F.col(text).alias("_text"),
    ).filter("_text <> ''")
    lines = base.select("_key", "_site", F.xxhash64("_text").alias("_t1"), F.hash("_text").alias("_t2"), F.split("_text", "\n").alias("_lines"))
    sizes = F.transform("_lines", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    top = F.slice(F.sort_array(F.array_distinct(sizes), asc=False), 1, 2)
    rows = lines.withColumn("_top", top).select(
        "_key", "_site", "_t1", "_t2", "_top", F.posexplode("_lines").alias("_pos", "_line")
    )
    first, second = F.col("_top")[0]["x"], F.when(F.size("_top") > 1, F.col("_top")[1]["x"])
    return rows.filter(_is_text(F.col("_line"))).select(
        "_key", "_site", "_t1", "_t2", *line_keys(F.col("_line")), F.xxhash64(F.when(first == F.col("_line"), second).otherwise(first)).alias("_ctx"), "_pos"
    )


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, min_contexts: float = MIN_CONTEXTS) -> DataFrame:
    """``(_h1, _h2)`` of the boilerplate lines in ``occurrences``."""
    per_text = found.groupBy("_h1", "_h2", "_ctx", "_t1", "_t2").agg(F.min(F.struct("_key", "_site")).alias("_one"))
    per_context = per_text.groupBy("_h1", "_h2", "_ctx").agg(F.min("_one").alias("_one"), F.count(F.lit(1)).alias("_docs"))
    per_line = per_context.groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg("_one._site", F.lit(LG_CONFIG)).alias("_sketch"),
        F.count(F.lit(1)).alias("_contexts"),
        F.sum("_docs").alias("_docs"),
    )
    spread = per_line.filter((F.col("_contexts") >= min_sites) & (F.col("_contexts") >= min_contexts * F.col("_docs"))).select(
        "_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_sites")
    )
    error = 4 * 1.04 / 2 ** (LG_CONFIG / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    sure = spread.filter(F.col("_sites") > high).select("_h1", "_h2")
    near = spread.filter(F.col("_sites").between(low, high)).select("_h1", "_h2")
    exact = (
        per_context.join(near, ["_h1", "_h2"], "left_semi")
        .select("_h1", "_h2", F.col("_one._site").alias("_site"))
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_sites"))
        .filter(F.col("_sites") >= min_sites)
        .select("_h1", "_h2")
    )
    return sure.unionByName(exact)


def drop_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_contexts: float = MIN_CONTEXTS,
    removed: str = "lines_removed",
) -> DataFrame:
    """``docs`` without boilerplate lines, and the number of lines removed.

    Keys must be unique and not null for lines to be removed: rows with a null
    key keep their text.
    """
    removed = free_name(docs.columns, removed)
    found = occurrences(docs, key, text, site)
    bad = boilerplate(found, min_sites, min_contexts)
    own, places = free_name(docs.columns, "_own"), free_name(docs.columns, "_places")
    at = (
        found.select("_key", "_h1", "_h2", "_pos")
        .join(bad, ["_h1", "_h2"])
        .groupBy(F.col("_key").alias(own))
        .agg(F.collect_set("_pos").alias(places))
    )
    joined = docs.join(at, F.col(key) == F.col(own), "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(places, i))
    cleaned = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).alias(removed),
    )
