"""Edge lists as text: two integers a line, further columns ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens


def parse_edges(lines: DataFrame, permissive: bool = False, weighted: bool = False) -> DataFrame:
    """(src, dst) from lines (value): comments (#), blank lines and lines of one token are left out.

    A token that isn't a number is an error, or with ``permissive`` leaves its
    line out. With ``weighted`` the third token is w, 1 where there is none.
    """
    parts = lines.select(tokens(F.col("value")).alias("t")).where(~F.element_at("t", 1).startswith("#") & (F.size("t") >= 2))
    number = lambda i, kind="long": (F.get("t", F.lit(i)).try_cast(kind) if permissive else F.get("t", F.lit(i)).cast(kind))
    w = [F.when(F.size("t") < 3, F.lit(1.0)).otherwise(number(2, "double")).alias("w")] if weighted else []
    edges = parts.select(number(0).alias("src"), number(1).alias("dst"), *w)
    return edges.dropna() if permissive else edges


def read_edges(spark: SparkSession, path: str, permissive: bool = False, weighted: bool = False) -> DataFrame:
    return parse_edges(spark.read.text(path), permissive, weighted)
