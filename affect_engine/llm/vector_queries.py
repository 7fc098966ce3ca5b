"""Registered queries of the vector operators: clusters and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, whitening
from .registry import query, table


def cluster_sql(dims: int = 64, scale: int = 256, clusters: int = 40, rounds: int = 5, seed: str = "2") -> str:
    """The rounds written out, each an assignment and an update; sums per component."""
    ctes = [
        f"""kept AS (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE len(embedding) = {dims}
        AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(CAST(c AS DOUBLE)))) = {dims}
    )""",
        f"""c0 AS (
      SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x AS mid FROM kept
      ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters}
    )""",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
      SELECT vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS best FROM (
        SELECT vec_id, x, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - mid[i]) * (x[i] - mid[i]))) AS d
        FROM kept CROSS JOIN c{i}
      ) GROUP BY vec_id
    )"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (
      SELECT c, coalesce(moved, mid) AS mid FROM c{i} LEFT JOIN (
        SELECT c, list(v ORDER BY j) AS moved FROM (
          SELECT best.c AS c, j, CAST((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
          FROM a{i}, range(1, {dims + 1}) r(j) GROUP BY best.c, j
        ) GROUP BY c
      ) USING (c)
    )"""
            )
    return f"""WITH {", ".join(ctes)},
    inertias AS (SELECT best.c AS c, sum(best.d) AS own FROM a{rounds} GROUP BY best.c)
    SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia,
           CAST((SELECT sum(own) FROM inertias) AS BIGINT) AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c JOIN inertias ON inertias.c = best.c"""


@query("op12_centroid_clusters", cluster_sql())
def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select("vec_id", found["cluster"].cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
