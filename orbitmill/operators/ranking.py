"""Orders, top-k tables and comparison of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import dense_index


def ranked(scores: DataFrame) -> DataFrame:
    """All vertices by score, the highest first; equal scores by node_id."""
    return scores.orderBy(F.col("score").desc(), F.col("node_id"))


def top_k(scores: DataFrame, k: int = 20) -> DataFrame:
    """rank from 1, node_id, score of the k best, or of all where there are fewer."""
    best = ranked(scores).limit(k)
    order = Window.orderBy(F.col("score").desc(), F.col("node_id"))
    return best.select(F.row_number().over(order).cast("long").alias("rank"), "node_id", "score")


def full_ranking(scores: DataFrame) -> DataFrame:
    """rank, node_id, score of every vertex, numbered without gathering them in one task."""
    keyed = scores.select("node_id", "score", F.struct((-F.col("score")).alias("s"), F.col("node_id").alias("i")).alias("_order"))
    return dense_index(keyed, "_order", "_place").select((F.col("_place") + 1).alias("rank"), "node_id", "score")


def compare_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: vertices in both, in one only, and the largest difference of scores."""
    both = a.select("node_id", F.col("score").alias("x")).join(b.select("node_id", F.col("score").alias("y")), "node_id", "full")
    return both.agg(
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("n_one"),
        F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"),
    )
