"""Graphs made from the test tables, and the same graphs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialise
from ..operators import graph as g
from ..operators.prefix import dense_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were ordered together: symmetric, without loops, weight 1.

    Orders' parts meet as arrays, so each order is shuffled once and pairs are
    made and deduplicated before the second shuffle.
    """
    by_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).where(F.size("parts") > 1)
    pairs = by_order.select(F.explode("parts").alias("src"), "parts").select("src", F.explode("parts").alias("dst"))
    return g.edge_columns(g.without_loops(pairs).distinct())


COPURCHASE = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, 1.0::DOUBLE AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, weighted by lines; has loops."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplied = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per_order = supplied.groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    both = per_order.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("n").cast("double").alias("w"))


TRADE = (
    "SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
)
TRADE_NO_LOOPS = f"SELECT * FROM ({TRADE}) WHERE src <> dst"


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and suppliers (odd ids): bipartite, symmetric."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return g.edge_columns(g.symmetrised(pairs.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))))


CUSTOMER_SUPPLIER = (
    "SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "UNION SELECT 2 * l_suppkey + 1, 2 * o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User of an event to the user of the next event, weighted by their number; has loops."""
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"))
    numbered = materialise(dense_index(events, "at").select("idx", "user_id"), "events")
    after = numbered.select((F.col("idx") - 1).alias("idx"), F.col("user_id").alias("dst"))
    pairs = numbered.join(after, "idx").where("user_id is not null and dst is not null")
    return pairs.groupBy(F.col("user_id").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


HANDOFF = (
    "SELECT src::BIGINT AS src, dst::BIGINT AS dst, count(*)::DOUBLE AS w FROM "
    "(SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2"
)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-offs as lines of text in several spellings, among comments, blank and short lines."""
    pairs = handoff(spark, sf_dir).select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.pmod("src", F.lit(4)).alias("m"))
    line = (
        F.when(F.col("m") == 0, F.concat(F.lit("  "), "a", F.lit(" \t "), "b", F.lit("  ")))
        .when(F.col("m") == 1, F.concat_ws(" ", "a", "b", F.lit("7")))
        .when(F.col("m") == 2, F.concat_ws("\t", "a", "b"))
        .otherwise(F.concat_ws("   ", "a", "b"))
    )
    noise = spark.sql(r"SELECT * FROM VALUES ('# comment 1 2'), (''), ('   '), ('17'), ('  # 3 4'), ('#'), ('\t') AS t(value)")
    return pairs.select(line.alias("value")).unionByName(noise)
