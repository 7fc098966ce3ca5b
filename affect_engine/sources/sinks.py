"""Sinks: export CSV, pair splits, row and statistics tables, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.export import EXPORT_COLUMNS


def write_export_csv(export: DataFrame, path: str, buckets: int = 16, mode: str = "errorifexists") -> None:
    """The export columns as CSV with missing values empty, spread over buckets.

    A folder per recording would mean millions of tiny files, so recordings
    share a bounded number of folders.
    """
    bucketed = export.select(
        "video_id", *EXPORT_COLUMNS, F.pmod(F.xxhash64("video_id"), F.lit(buckets)).alias("bucket")
    )
    bucketed.write.mode(mode).partitionBy("bucket").csv(
        path, header=True, nullValue="", emptyValue="", escape='"'
    )


def write_splits(pairs: DataFrame, path: str, side: str = "side", mode: str = "errorifexists") -> None:
    """Pairs with one folder per split name."""
    pairs.write.mode(mode).partitionBy(side).parquet(path)


def write_rows_and_statistics(rows: DataFrame, statistics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(f"{path}/rows")
    statistics.write.mode(mode).parquet(f"{path}/statistics")


def write_lines(rows: DataFrame, order: Sequence[Column | str], line: Column, path: str, mode: str = "errorifexists") -> None:
    """One line a row, in order over many files: each file holds a range of ``order``.

    Line breaks inside a value become blanks, as they would add lines.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.translate(line, "\n\r", "  ").alias("value")).write.mode(mode).text(path)


def as_documents(rows: DataFrame, key: str, order: str, size: int = 1024) -> DataFrame:
    """JSON documents of at most ``size`` consecutive rows each."""
    fields = [c for c in rows.columns if c != key]
    part = F.floor(F.col(order) / size).cast("long")
    return rows.groupBy(key, part.alias("part")).agg(
        F.to_json(
            F.struct(
                F.create_map(F.lit("part"), F.first(part).cast("string")).alias("metadata"),
                F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("segments"),
            )
        ).alias("value")
    )
