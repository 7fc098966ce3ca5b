"""Lineage cuts, temporary tables and connected components for the operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affect_engine.session import scratch_path


def saved(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """``df`` written to the folder all executors share, and read back.

    The path is added to ``folders``, so that the caller can remove it once no
    later step reads it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete written tables through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    for path in folders:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    folders.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Folders of temporary tables, removed at the end."""
    folders: list[str] = []
    try:
        yield folders
    finally:
        remove(spark, folders)


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of the input has it (names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def components(links: DataFrame, folders: list[str]) -> DataFrame:
    """``(id, component)`` of every id in ``links (a, b)``: the smallest id reachable.

    Large-star and small-star in turn, each a join and an aggregate, until the
    links stop changing. A hub with many links is spread by its partner rows;
    only the two-column link table is ever shuffled. Ids that occur only in
    links to themselves are left out.
    """
    links = saved(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
        folders,
    )
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        links = saved(small, "links", folders)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
