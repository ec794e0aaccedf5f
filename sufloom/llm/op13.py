"""op13: centroid clustering of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm.centroid_clustering import cluster_vectors

NAME = "op13_centroid_clustering"
ROUNDS = 10


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=ROUNDS, dim=64, scale=1024, salt="3:")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
apart{i} AS MATERIALIZED (
  SELECT v.row, v.v, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS BIGINT) AS distance
  FROM ints v, centre{i} c),
near{i} AS MATERIALIZED (SELECT row, any_value(v) AS v, min(struct_pack(distance := distance, cluster := cluster)) AS x FROM apart{i} GROUP BY row)""")
        if i < rounds:
            parts.append(f"""
sums{i} AS (SELECT x.cluster AS cluster, j, sum(v[j]) AS s, count(*) AS n FROM near{i}, unnest(range(1, 65)) AS u(j) GROUP BY x.cluster, j),
means{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM sums{i} GROUP BY cluster),
centre{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM centre{i} c LEFT JOIN means{i} m USING (cluster))""")
    return f"""
WITH ints AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
centre0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (SELECT v, sha256('3:' || vec_id) AS h FROM ints ORDER BY h LIMIT 8)),{','.join(parts)}
SELECT i.vec_id, n.x.cluster AS cluster, n.x.distance AS distance, CAST(sum(n.x.distance) OVER (PARTITION BY n.x.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.x.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN ints i USING (row) JOIN centre{rounds} c ON c.cluster = n.x.cluster
"""


ORACLE_SQL = _sql()
