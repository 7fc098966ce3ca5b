"""Registered query of suffix-array dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixes
from .registry import query, table


@query(
    "op11_suffix_dedup",
    f"""
    WITH texts AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
    ), parts AS (
      SELECT doc_id, c, substr(h, 2 * c + 1, 2 * (256 + {suffixes.SIZE - 1})) AS h
      FROM (SELECT doc_id, h, unnest(range(0, n, 256)) AS c FROM texts)
    ), strings AS (
      SELECT doc_id, c + i AS p, substr(h, 2 * i + 1, {2 * suffixes.SIZE}) AS s
      FROM (SELECT doc_id, c, h, unnest(range(least(256, length(h) // 2 - {suffixes.SIZE - 1}))) AS i FROM parts)
    ), found AS (
      SELECT doc_id, p FROM strings JOIN (SELECT s, min(doc_id) AS least FROM strings GROUP BY s) USING (s) WHERE least < doc_id
    ), runs AS (
      SELECT doc_id, p, sum(CASE WHEN p <= last + {suffixes.SIZE} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM found)
    ), spans AS (
      SELECT doc_id, min(p) AS a, max(p) + {suffixes.SIZE} AS b FROM runs GROUP BY doc_id, run
    ), gaps AS (
      SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
      UNION ALL SELECT t.doc_id, coalesce(max(b), 0), any_value(n) FROM texts t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
    ), kept AS (
      SELECT doc_id, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS k FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
    ), sums AS (
      SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone FROM spans GROUP BY doc_id
    )
    SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(k)) AS kept_sha256
    FROM texts JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
)
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
