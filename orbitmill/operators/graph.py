"""Graphs as edge tables: cleaning, vertex numbering, CSR views and checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialise
from .prefix import dense_index, running_sum, running_sums

#: Positions of a CSR array that a task holds at a time.
BLOCK_POSITIONS = 1 << 16


@dataclass(frozen=True)
class Graph:
    """Edges (src long, dst long, w double) and whether they have a direction."""

    edges: DataFrame
    directed: bool = False
    weighted: bool = False


def edge_columns(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """(src, dst, w) of any table of pairs; without a weight column w is 1."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("w"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrised(edges: DataFrame) -> DataFrame:
    """Distinct ordered pairs of both directions."""
    pairs = edges.select("src", "dst")
    return pairs.union(reversed_edges(pairs)).distinct()


def undirected(edges: DataFrame) -> Graph:
    """Without loops, both directions, each pair once, weight 1."""
    return Graph(edge_columns(symmetrised(without_loops(edges))), directed=False)


def directed(edges: DataFrame, weight: str | None = None) -> Graph:
    """Without loops; each ordered pair once, or, with weights, the weights of equal pairs summed."""
    clean = without_loops(edge_columns(edges, weight=weight))
    if weight is None:
        return Graph(edge_columns(clean.select("src", "dst").distinct()), directed=True)
    return Graph(clean.groupBy("src", "dst").agg(F.sum("w").alias("w")), directed=True, weighted=True)


def unweighted(graph: Graph) -> Graph:
    """The same edges, all of weight 1."""
    return Graph(edge_columns(graph.edges.select("src", "dst")), graph.directed)


def counted_ends(edges: DataFrame, row: str = "src", col: str = "dst") -> DataFrame:
    """id of every end of an edge and d, in how many edges it is the ``row``; one pass over the edges."""
    end = lambda c, n: F.struct(F.col(c).alias("id"), F.lit(n).cast("long").alias("d"))
    return edges.select(F.explode(F.array(end(row, 1), end(col, 0))).alias("e")).groupBy("e.id").agg(F.sum("e.d").alias("d"))


def vertices(edges: DataFrame) -> DataFrame:
    """node_id of every end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def vertex_index(edges: DataFrame) -> DataFrame:
    """node_id and idx, its place in ascending order from 0."""
    return dense_index(materialise(vertices(edges), "vertices"), "node_id")


def encoded(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges between indices: (src_idx, dst_idx, w)."""
    a = index.select(F.col("node_id").alias("src"), F.col("idx").alias("src_idx"))
    b = index.select(F.col("node_id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(a, "src").join(b, "dst").select("src_idx", "dst_idx", *[c for c in edges.columns if c not in ("src", "dst")])


def decoded(values: DataFrame, index: DataFrame) -> DataFrame:
    """Values by index as values by node_id."""
    return values.join(index, "idx").drop("idx")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, neighbors ascending and their weights."""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("row"))
    return rows.select("src", F.col("row.dst").alias("neighbors"), F.col("row.w").alias("weights"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id and its number of edges out; vertices without any have 0."""
    return counted_ends(edges).select(F.col("id").alias("node_id"), F.col("d").alias("degree"))


def csr_rows(edges: DataFrame) -> DataFrame:
    """idx, node_id, row_start, degree of every vertex in CSR order."""
    by_vertex = materialise(degrees(edges).withColumn("_one", F.lit(1).cast("long")), "degrees")
    return running_sums(by_vertex, "node_id", {"row_start": "degree", "idx": "_one"}).select("idx", "node_id", "row_start", "degree")


def csr_columns(edges: DataFrame, index: DataFrame) -> DataFrame:
    """pos and col_idx (and w): neighbours row by row, ascending within a row."""
    coded = materialise(encoded(edges, index), "coded-edges")
    per_row = materialise(coded.groupBy("src_idx").agg(F.count(F.lit(1)).alias("degree")), "row-degrees")
    starts = running_sum(per_row, "src_idx", "degree", "row_start").select("src_idx", "row_start")
    within = F.row_number().over(Window.partitionBy("src_idx").orderBy("dst_idx")) - 1
    return coded.withColumn("i", within).join(starts, "src_idx").select((F.col("row_start") + F.col("i")).cast("long").alias("pos"), F.col("src_idx").alias("row_idx"), F.col("dst_idx").alias("col_idx"), "w")


def _owned(rows: pa.Table, columns: pa.Table) -> pa.Table:
    """(src_idx, dst_idx) of one block of positions; a row ends where the next that has columns begins or by its degree."""
    start, idx = rows.column("row_start").to_numpy(), rows.column("idx").to_numpy()
    order = np.argsort(start, kind="stable")
    start, idx, end = start[order], idx[order], (start + rows.column("degree").to_numpy())[order]
    pos, col = columns.column("pos").to_numpy(), columns.column("col_idx").to_numpy()
    of = np.searchsorted(start, pos, "right") - 1
    have = (of >= 0) & (pos < end[of]) if len(start) else np.zeros(len(pos), bool)
    return pa.table({"src_idx": pa.array(idx[of[have]], pa.int64()), "dst_idx": pa.array(col[have], pa.int64())})


def csr_to_edges(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(src_idx, dst_idx) from row starts (idx, row_start, degree) and columns (pos, col_idx).

    Positions meet their rows in blocks of ``BLOCK_POSITIONS``: a row goes to each
    block it has positions in, so nothing is as long as a row or sent to all tasks.
    """
    block = lambda c: F.floor(c / F.lit(BLOCK_POSITIONS)).cast("long")
    last = F.col("row_start") + F.col("degree") - 1
    owners = rows.where("degree > 0").select("idx", "row_start", "degree", F.explode(F.sequence(block(F.col("row_start")), block(last))).alias("block"))
    placed = columns.select("pos", F.col("col_idx").cast("long").alias("col_idx"), block(F.col("pos")).alias("block"))
    return owners.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_owned, "src_idx long, dst_idx long")


def csr_checks(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: n, nnz, end (where the last row ends), and whether the arrays fit together."""
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("row_start") + F.col("degree")), F.lit(0)).alias("end"))
    cols = columns.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.max("col_idx"), F.lit(-1)).alias("most"))
    return ends.join(cols).select("n", "nnz", F.col("end").cast("long").alias("end"), ((F.col("end") == F.col("nnz")) & (F.col("most") < F.col("n"))).alias("valid"))


def one_way_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing."""
    pairs = edges.select("src", "dst").distinct()
    return pairs.join(reversed_edges(pairs), ["src", "dst"], "left_anti")


def graph_type(edges: DataFrame) -> DataFrame:
    """One row: n_vertices, nnz, n_one_way and whether the graph is symmetric."""
    n = vertices(edges).agg(F.count(F.lit(1)).alias("n_vertices"))
    m = edges.agg(F.count(F.lit(1)).alias("nnz"))
    one_way = one_way_edges(edges).agg(F.count(F.lit(1)).alias("n_one_way"))
    return n.join(m).join(one_way).select("*", (F.col("n_one_way") == 0).alias("symmetric"))


def row_degree(neighbors: Column) -> Column:
    return F.size(neighbors).cast("long")
