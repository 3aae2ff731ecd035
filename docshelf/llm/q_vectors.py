"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from .nn_descent import near_vectors
from .ns_kmeans import cluster_vectors
from .queries import query


@query("op4_nn_descent")
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return near_vectors(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def _kmeans_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """The same clustering by comparing every vector with every centroid in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    d{r} AS MATERIALIZED (SELECT p.vid, c.num, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d
                          FROM p JOIN c{r} c USING (pos) GROUP BY p.vid, c.num),
    a{r} AS MATERIALIZED (SELECT vid, min({{'d': d, 'num': num}}) AS best FROM d{r} GROUP BY vid)""")
        if r < rounds:
            steps.append(f"""
    c{r + 1} AS MATERIALIZED (SELECT c.num, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT best.num AS num, pos, floor(sum(x) / count(*))::BIGINT AS x
        FROM p JOIN a{r} USING (vid) GROUP BY best.num, pos) m ON m.num = c.num AND m.pos = c.pos)""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
    p AS MATERIALIZED (SELECT vid, unnest(range(1, {dim + 1})) AS pos, unnest(v) AS x FROM kept),
    c0 AS MATERIALIZED (
        SELECT num, unnest(range(1, {dim + 1})) AS pos, unnest(v) AS x
        FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS num FROM kept)
        WHERE num < {k}),{",".join(steps)},
    shas AS (SELECT num, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY num)
    SELECT vec_id, best.num::INTEGER AS cluster, best.d AS distance,
           sum(best.d) OVER (PARTITION BY best.num)::BIGINT AS cluster_inertia,
           sum(best.d) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (vid) JOIN shas ON num = best.num
    """


@query("op13_ns_kmeans", sql=_kmeans_sql())
def op13_ns_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return cluster_vectors(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
