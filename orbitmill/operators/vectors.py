"""Vectors over vertices as tables (id, x), and the products and norms of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import absolute_difference, squared_difference, unit_hash


def uniform(vertices: DataFrame, n: int) -> DataFrame:
    """1 / sqrt(n) everywhere."""
    return vertices.select(F.col("node_id").alias("id"), F.lit(1.0 / n**0.5 if n else 0.0).alias("x"))


def random_unit(vertices: DataFrame, seed: int) -> DataFrame:
    """Numbers in [0, 1) from a seeded hash of the id, scaled to norm 1."""
    raw = vertices.select(F.col("node_id").alias("id"), unit_hash(seed, F.col("node_id")).alias("x"))
    return scaled(raw, 1.0 / (norm(raw) or 1.0))


def spmv_parts(edges: DataFrame, x: DataFrame, direction: str = "out", weighted: bool = True) -> DataFrame:
    """(id, y, x): one product for each edge, with 0 as the old value."""
    row, col = ("src", "dst") if direction == "out" else ("dst", "src")
    product = F.col("w") * F.col("x") if weighted else F.col("x")
    return edges.join(x.select(F.col("id").alias(col), "x"), col).select(F.col(row).alias("id"), product.alias("y"), F.lit(0.0).alias("x"))


def spmv(edges: DataFrame, x: DataFrame, direction: str = "out", weighted: bool = True, shift: bool = False) -> DataFrame:
    """(id, y, x): y = A x, or (A + I) x with ``shift``, for every id of x, with the old value beside it.

    ``out`` gathers over a row's edges (y[src] from x[dst]), ``in`` over a
    column's. One join brings values to edges; one aggregation, partial before
    its shuffle, sums products and keeps every vertex. The join sorts both
    sides: Spark's estimates of edges that are still to be made, or that lie
    compressed, are far too low, and it would broadcast them.
    """
    parts = spmv_parts(edges.hint("merge"), x, direction, weighted)
    own = x.select("id", (F.col("x") if shift else F.lit(0.0)).alias("y"), "x")
    return parts.unionByName(own).groupBy("id").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))


def norm_of(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def norm(v: DataFrame) -> float:
    return v.agg(F.coalesce(norm_of(F.col("x")), F.lit(0.0))).collect()[0][0]


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of products."""
    return a.join(b.select("id", F.col("x").alias("y")), "id").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def scaled(v: DataFrame, factor: float) -> DataFrame:
    return v.select("id", (F.col("x") * F.lit(factor)).alias("x"))


def combined(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """The sum of vectors, each times its factor."""
    first, *rest = [scaled(v, f) for f, v in parts]
    for v in rest:
        first = first.unionByName(v)
    return first.groupBy("id").agg(F.sum("x").alias("x"))


def residuals(after: DataFrame, before: DataFrame) -> DataFrame:
    """One row: l1, l2, mean_l1 and max_abs of the difference."""
    a, b = F.col("x"), F.col("y")
    both = after.join(before.select("id", b_alias()), "id")
    return both.agg(
        F.sum(absolute_difference(a, b)).alias("l1"),
        F.sqrt(F.sum(squared_difference(a, b))).alias("l2"),
        F.avg(absolute_difference(a, b)).alias("mean_l1"),
        F.max(absolute_difference(a, b)).alias("max_abs"),
    )


def b_alias() -> Column:
    return F.col("x").alias("y")


def signed_by_largest(v: DataFrame) -> DataFrame:
    """v with the sign that makes its entry of largest size (of equal ones the least id's) positive."""
    best = v.agg(F.max(F.struct(F.abs("x").alias("size"), (-F.col("id")).alias("neg"), F.col("x").alias("best"))).alias("m"))
    sign = F.when(F.col("m.best") < 0, -1.0).otherwise(1.0)
    return v.join(F.broadcast(best.select(sign.alias("sign"))), F.lit(True)).select("id", (F.col("x") * F.col("sign")).alias("x"))
