"""Linear-output pair search within buckets, and connected components of links.

Buckets may be of any size. Members of a bucket are dealt by hash to chunks of
about ``CHUNK``; a task takes one pair of chunks, so no task sees a whole hot
bucket, and it returns a spanning forest of the links it finds instead of the
links themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

CHUNK = 1024


def chunk_pairs(members: DataFrame, keys: list[str], member: str, scratch: Scratch, chunk: int | None = None) -> DataFrame:
    """Members of buckets of two or more, once for each pair of chunks (ci <= cj) of their bucket.

    A bucket of m members in c chunks gives m * c rows; buckets of one are dropped.
    ``side`` is the row's own chunk.
    """
    # as a table of its own, so that a hot bucket's members can be split among join tasks
    sizes = scratch.table(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size")).where("bucket_size > 1"), "bucket-sizes")
    held = members.join(sizes, keys)
    n = F.ceil(F.col("bucket_size") / F.lit(chunk or CHUNK)).cast("int")
    dealt = held.withColumn("n_chunks", n).withColumn("side", F.pmod(F.xxhash64(F.lit("chunk"), F.col(member)), F.col("n_chunks").cast("long")).cast("int"))
    return (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn("ci", F.least("side", "other"))
        .withColumn("cj", F.greatest("side", "other"))
        .drop("other", "n_chunks", "bucket_size")
    )


def forest(n: int, links: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of n members the least member that its links lead to."""
    low = np.arange(n)
    a, b = links
    while len(a):
        # labels are roots here: the greater of a link's two is hooked to the lesser
        one, other = low[a], low[b]
        least = np.minimum(one, other)
        np.minimum.at(low, one, least)
        np.minimum.at(low, other, least)
        while not np.array_equal(up := low[low], low):
            low = up
        keep = low[a] != low[b]
        a, b = a[keep], b[keep]
    return low


def linked_pairs(chunked: DataFrame, keys: list[str], found: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs found() on each pair of chunks: at most two chunks of rows."""
    return chunked.groupBy(*keys, "ci", "cj").applyInArrow(found, schema)


def components(links: DataFrame, scratch: Scratch, tag: str = "components") -> DataFrame:
    """node, component (the least node that links (a, b) lead to) for every node of a link; a table of ``scratch``.

    Every round a node takes the least label among its neighbours' and then the
    label of its label; rounds go on until nothing changes. Links are kept once
    on disk and labels are rewritten each round, so lineage stays short; only the
    last round's tables stay. Null ends are ignored.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    with Scratch(scratch.spark) as own:
        both = own.table(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
        label = scratch.table(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), f"{tag}-labels", replaces=f"{tag}-labels")
        while True:
            near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
            closer = label.join(near, label["node"] == near["a"], "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("mid"))
            closer = own.table(closer, f"{tag}-near", replaces="near")
            # hook: the old label's own label also falls to the least that its members have seen
            hooked = own.table(closer.groupBy(F.col("was").alias("root")).agg(F.min("mid").alias("hook")), f"{tag}-hooks", replaces="hooks")
            upper = closer.join(hooked, closer["mid"] == hooked["root"], "left").select("node", "was", F.least("mid", F.coalesce("hook", "mid")).alias("component"))
            step = upper.join(hooked.select(F.col("root").alias("r2"), F.col("hook").alias("h2")), upper["was"] == F.col("r2"), "left").select("node", F.least("component", F.coalesce("h2", "component")).alias("component"), F.col("was"))
            after = scratch.table(step, f"{tag}-labels", replaces=f"{tag}-labels")
            label = after.select("node", "component")
            if after.where("component <> was").isEmpty():
                return label
