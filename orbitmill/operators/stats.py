"""Statistics of a graph; one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees


def degree_stats(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """n, nnz, num_edges (of an undirected graph), density (0 of an empty graph) and the CSR arrays' size in MB."""
    by_vertex = degrees(edges).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("nnz"))
    n, nnz = F.col("n"), F.col("nnz")
    return by_vertex.select("n", "nnz", F.floor(nnz / 2).cast("long").alias("num_edges"), *_sizes(n, nnz))


def _sizes(n: Column, nnz: Column) -> tuple[Column, Column]:
    density = F.when(n > 0, nnz / (n.cast("double") * n)).otherwise(0.0)
    return density.alias("density"), (F.lit(4.0) * (n + 1 + 2 * nnz) / F.lit(1e6)).alias("csr_mb")


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: graph_stats() and degree_stats() from one pass over the edges."""
    d = degrees(edges).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("nnz"),
        F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"),
    )
    return d.select("*", *_sizes(F.col("n"), F.col("nnz")))


def score_summary(scores: DataFrame) -> DataFrame:
    """score_sum, top_node (of equal scores the least id) and top_score."""
    best = F.max(F.struct("score", (-F.col("node_id")).alias("neg")))
    return scores.agg(F.sum("score").alias("score_sum"), best.alias("best")).select("score_sum", (-F.col("best.neg")).alias("top_node"), F.col("best.score").alias("top_score"))
