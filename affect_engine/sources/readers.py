"""Sources: stage documents, corpora, tables by suffix, line-aligned files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "text string, label string, source string, labels_source string, token_count int"


def stage_documents(
    spark: SparkSession, path: str, row: str, field: str, multi_line: bool = True
) -> DataFrame:
    """Rows of the list ``field`` of JSON documents, with the file they came from."""
    schema = f"metadata map<string, string>, `{field}` array<struct<{row}>>"
    documents = spark.read.schema(schema).json(path, multiLine=multi_line)
    return documents.select("metadata", F.col("_metadata.file_path").alias("path"), F.inline(field))


def describe_artefact(path: Column) -> dict[str, Column]:
    """Recording, kind, language and model told from a file's path."""
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    kind = F.regexp_extract(name, r"^(transcription|local_segments|global_scenes|arousal|emotion|scenes)", 1)
    english = name.rlike(r"(_en_|_translated$)")
    return {
        "video_id": F.nullif(F.regexp_extract(path, r"video-([^/]+)/", 1), F.lit("")),
        "kind": F.nullif(kind, F.lit("")),
        "lang": F.when(english, "en").otherwise("ru"),
        "model": F.nullif(F.regexp_extract(name, r"_(?:en|ru)_([A-Za-z0-9-]+)", 1), F.lit("")),
    }


def corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS, multi_line: bool = True) -> DataFrame:
    """Corpus as CSV, compressed or not; texts may hold quotes.

    With ``multi_line`` texts may hold line breaks too, and a file is one task;
    without it plain files are split.
    """
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=multi_line)


READERS = {
    "csv": dict(format="csv", header=True, escape='"'),
    "tsv": dict(format="csv", header=True, escape='"', sep="\t"),
    "parquet": dict(format="parquet"),
    "json": dict(format="json"),
    "jsonl": dict(format="json"),
}


def table(
    spark: SparkSession,
    path: str,
    suffix: str,
    required: Sequence[str],
    text: str = "text",
    schema: str | None = None,
    limit: int | None = None,
    at_least: int = 1,
    multi_line: bool = True,
) -> DataFrame:
    """Read by suffix, check columns, drop blank texts, guard the row count.

    ``limit`` is the caller's own request for fewer rows. ``multi_line`` allows
    line breaks inside the values of csv, tsv and json, at one task a file.
    """
    if suffix not in READERS:
        raise ValueError(f"unsupported suffix {suffix!r}; use one of {sorted(READERS)}")
    options = dict(READERS[suffix])
    if suffix in ("csv", "tsv", "json"):
        options["multiLine"] = multi_line
    reader = spark.read.format(options.pop("format")).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    kept = df.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    if limit is not None:
        kept = kept.limit(limit)
    if kept.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} usable rows in {path}")
    return kept


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file, or of a folder of them, with their number.

    Files follow each other by part number and name, as ``sinks.write_lines``
    leaves them. Lines are numbered inside their stretch of a file; a manifest of
    the stretches' counts, one row each, gives the offsets.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    placed = lines.where(F.col("value").isNotNull() & (F.col("value") != "")).select(
        F.col("value").alias("text"), "file_path", "file_block_start", F.monotonically_increasing_id().alias("__m")
    )
    stretch = ["file_path", "file_block_start"]
    # The lines of a stretch are read in order by one task.
    manifest = placed.groupBy(*stretch).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    name = F.element_at(F.split("file_path", "/"), -1)
    part = F.coalesce(F.nullif(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    earlier = Window.orderBy(part, name, "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select(*stretch, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    return placed.join(offsets, stretch).select((F.col("__m") - F.col("__first") + F.col("__o")).alias("line_no"), "text")


def zip_lines(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("en", "ru")) -> DataFrame:
    """Pair two numbered line tables; the shorter one decides the length."""
    a = left.withColumnRenamed("text", names[0])
    b = right.withColumnRenamed("text", names[1])
    return a.join(b, "line_no")


def finished_runs(runs: DataFrame, exports: DataFrame) -> DataFrame:
    """Recordings that have an export, newest first."""
    done = exports.groupBy("video_id").agg(F.max("modified").alias("modified"))
    return runs.join(done, "video_id").orderBy(F.desc("modified"), F.desc("video_id"))


def transcript_catalog(documents: DataFrame) -> DataFrame:
    """Selected metadata and statistics of transcription documents."""
    meta, stats = F.col("metadata"), F.col("statistics")
    return documents.select(
        "path",
        meta["model"].alias("model"),
        meta["language"].alias("language"),
        meta["duration"].alias("duration"),
        stats["total_words"].alias("total_words"),
        stats["average_confidence"].alias("average_confidence"),
    )
