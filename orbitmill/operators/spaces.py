"""Where a solver's vectors live.

``BlockSpace`` keeps vectors of at most ``MOST_VERTICES`` entries on the driver
(a basis of long ones in files) and the matrix as blocks of compact rows, spread over the executors and read
again each iteration; a product is one job that sends the vector out and gets
partial sums back. ``TableSpace`` keeps vectors as tables and a product is a
join and an aggregation; it has no limit of size. Its edges lie in buckets by
the end that a product gathers from, so a step moves the vector and partial
sums, never the edges; ends with very many edges are apart, and their few values
are broadcast. Both start alike and give the same numbers up to the order of
sums. The graph is computed once, into a table that both are made from.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import unit_hash
from ..functions.scratch import Scratch, materialise
from . import vectors
from .graph import Graph, counted_ends, vertices

#: A vector of so many doubles is 16 MB; it and the ids are what a task is sent.
MOST_VERTICES = 1 << 21
#: Vectors that are kept lie in files of the driver's if they have so many entries.
FILE_ENTRIES = 1 << 17
#: Edges of one block.
BLOCK_EDGES = 1 << 19
#: Edges of one bucket of a table.
BUCKET_EDGES = 1 << 22


def _ends(direction: str) -> tuple[str, str]:
    """The end that a product is for and the end it gathers from."""
    return ("src", "dst") if direction == "out" else ("dst", "src")


class TableSpace:
    def __init__(self, edges: DataFrame, weighted: bool, direction: str, shift: bool, scratch: Scratch):
        self.spark, self.scratch = edges.sparkSession, scratch
        self.weighted, self.direction, self.shift = weighted, direction, shift
        _, col = _ends(direction)
        self.vertices = scratch.table(vertices(edges), "vertices")
        self.n = self.vertices.count()
        total = edges.count()
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_EDGES))
        # ends with over a quarter of a mean bucket's edges: 4 for each bucket at most
        often = edges.groupBy(col).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") * (4 * buckets) > F.lit(max(total, BUCKET_EDGES))).select(col)
        often = F.broadcast(scratch.table(often, "hot-ends"))
        self.hot = scratch.table(edges.join(often, col, "left_semi"), "hot-edges")
        self.hot_ends = None if self.hot.isEmpty() else often
        self.name = f"orbitmill_{uuid.uuid4().hex}"
        rest = edges.join(often, col, "left_anti") if self.hot_ends is not None else edges
        rest.repartition(buckets, col).write.bucketBy(buckets, col).option("path", scratch.folder("bucketed-edges")).saveAsTable(self.name)
        self.edges = self.spark.table(self.name)

    def uniform(self) -> DataFrame:
        return vectors.uniform(self.vertices, self.n)

    def random(self, seed: int) -> DataFrame:
        return self.scratch.table(vectors.random_unit(self.vertices, seed), "vector")

    def _product(self, x: DataFrame) -> DataFrame:
        """(id, y, x): the product beside the old value."""
        _, col = _ends(self.direction)
        y = vectors.spmv(self.edges, x, self.direction, self.weighted, self.shift)
        if self.hot_ends is None:
            return y
        few = F.broadcast(x.join(self.hot_ends.toDF("id"), "id", "left_semi"))
        parts = vectors.spmv_parts(self.hot, few, self.direction, self.weighted)
        return y.unionByName(parts).groupBy("id").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))

    def product(self, x: DataFrame) -> DataFrame:
        return self.scratch.table(self._product(x).select("id", F.col("y").alias("x")), "product", replaces="product")

    def step(self, x: DataFrame) -> tuple[DataFrame, float, float, float]:
        """The product scaled to norm 1 (x itself if it is zero), its norm, and how far it is from x: l1 and l2.

        x's own table goes when the new one, which holds its values, is written.
        """
        found = Observation()
        both = self._product(x).observe(found, F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("squares"))
        both = self.scratch.table(both, "iterate", replaces="iterate")
        size = found.get["squares"] ** 0.5
        if size == 0.0:
            return both.select("id", "x"), 0.0, 0.0, 0.0
        y, far = F.col("y") / F.lit(size), F.col("y") / F.lit(size) - F.col("x")
        row = both.agg(F.sum(F.abs(far)).alias("l1"), F.sqrt(F.sum(far * far)).alias("l2")).collect()[0]
        return both.select("id", y.alias("x")), size, row["l1"], row["l2"]

    def norm(self, v: DataFrame) -> float:
        return vectors.norm(v)

    def dot(self, a: DataFrame, b: DataFrame) -> float:
        return vectors.dot(a, b).collect()[0][0]

    def combined(self, parts: list[tuple[float, DataFrame]], keep: bool = False) -> DataFrame:
        """A sum of vectors; without ``keep`` it lasts until the next one."""
        made = vectors.scaled(parts[0][1], parts[0][0]) if len(parts) == 1 else vectors.combined(parts)
        return self.scratch.table(made, "vector", replaces=None if keep else "sum")

    def signed(self, v: DataFrame) -> DataFrame:
        return vectors.signed_by_largest(v)

    def scores(self, v: DataFrame) -> DataFrame:
        return materialise(v.select(F.col("id").alias("node_id"), F.col("x").alias("score")), "scores")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop()


def _blocks(ids: np.ndarray, cuts: np.ndarray, row: str, col: str, weighted: bool):
    """Edges as (block, row, col, w) by indices; a block is a run of rows, or a share of a row with many edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.searchsorted(ids, batch.column(row).to_numpy())
            j = np.searchsorted(ids, batch.column(col).to_numpy())
            lo, hi = np.searchsorted(cuts, i, "left"), np.searchsorted(cuts, i, "right")
            shares = np.maximum(hi - lo, 1)  # a row whose number is cut at repeatedly spans several blocks
            block = np.where(hi > lo, lo + j % shares, lo)
            columns = [pa.array(block), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
            if weighted:
                columns.append(batch.column("w"))
            yield pa.RecordBatch.from_arrays(columns, ["block", "i", "j", "w"][: len(columns)])

    return run


def _packed(rows: pa.Table) -> pa.Table:
    """One row for a block: its first row, where each row starts, columns and weights, as bytes."""
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    first = int(i[0])
    start = np.concatenate([[0], np.cumsum(np.bincount(i - first))]).astype("<i4")
    w = rows.column("w").to_numpy()[order].astype("<f8").tobytes() if "w" in rows.column_names else None
    return pa.table({"first": pa.array([first], pa.int64()), "start": pa.array([start.tobytes()], pa.binary()), "col": pa.array([j.astype("<i4").tobytes()], pa.binary()), "w": pa.array([w], pa.binary())})


def _multiply(x):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = x.value
        for batch in batches:
            firsts, sums = [], []
            for first, start, col, w in zip(*(batch.column(c) for c in ("first", "start", "col", "w")), strict=True):
                edge = np.frombuffer(start.as_buffer(), "<i4")
                terms = values[np.frombuffer(col.as_buffer(), "<i4")]
                if w.is_valid:
                    terms = terms * np.frombuffer(w.as_buffer(), "<f8")
                total = np.zeros(len(edge) - 1)
                full = np.flatnonzero(np.diff(edge))
                total[full] = np.add.reduceat(terms, edge[full])
                firsts.append(first.as_py())
                sums.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(sums, pa.binary())], ["first", "sums"])

    return run


class BlockSpace:
    def __init__(self, edges: DataFrame, weighted: bool, direction: str, shift: bool, scratch: Scratch, ids: np.ndarray, degree: np.ndarray):
        self.spark, self.scratch = edges.sparkSession, scratch
        self.ids, self.n, self.shift = ids, len(ids), shift
        self.files: tempfile.TemporaryDirectory | None = None
        row, col = _ends(direction)
        total = np.cumsum(degree)
        # a cut after every BLOCK_EDGES edges: the row in which it falls ends its block
        marks = np.arange(BLOCK_EDGES, int(total[-1]) if len(total) else 0, BLOCK_EDGES)
        cuts = np.searchsorted(total, marks)
        schema = "block long, i int, j int" + (", w double" if weighted else "")
        coded = edges.mapInArrow(_blocks(ids, cuts, row, col, weighted), schema)
        packed = coded.groupBy("block").applyInArrow(_packed, "first long, start binary, col binary, w binary")
        self.blocks = scratch.table(packed, "blocks").repartition(max(1, min(len(cuts) + 1, 4096))).persist(StorageLevel.MEMORY_AND_DISK)

    def uniform(self) -> np.ndarray:
        return np.full(self.n, 1.0 / np.sqrt(self.n) if self.n else 0.0)

    def random(self, seed: int) -> np.ndarray:
        ids = self.spark.createDataFrame(pa.table({"node_id": pa.array(self.ids, pa.int64())}))
        x = ids.select(unit_hash(seed, F.col("node_id")).alias("x")).toArrow().column("x").to_numpy()
        return x / (np.linalg.norm(x) or 1.0)

    def product(self, x: np.ndarray) -> np.ndarray:
        sent = self.spark.sparkContext.broadcast(x)
        y = x.copy() if self.shift else np.zeros(self.n)
        for first, sums in self.blocks.mapInArrow(_multiply(sent), "first long, sums binary").collect():
            part = np.frombuffer(bytes(sums))
            y[first : first + len(part)] += part
        sent.unpersist()
        return y

    def norm(self, v: np.ndarray) -> float:
        return float(np.linalg.norm(v))

    def dot(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ b)

    def step(self, x: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        """The product scaled to norm 1 (x itself if it is zero), its norm, and how far it is from x: l1 and l2."""
        y = self.product(x)
        size = self.norm(y)
        if size == 0.0:
            return x, 0.0, 0.0, 0.0
        y = y / size
        return y, size, float(np.abs(y - x).sum()), float(np.linalg.norm(y - x))

    def combined(self, parts: list[tuple[float, np.ndarray]], keep: bool = False) -> np.ndarray:
        out = np.zeros(self.n)
        for f, v in parts:
            out += f * v
        return self._filed(out) if keep and self.n >= FILE_ENTRIES else out

    def _filed(self, v: np.ndarray) -> np.ndarray:
        """The vector, read from a file where it is used."""
        if self.files is None:
            self.files = tempfile.TemporaryDirectory(prefix="orbitmill-", ignore_cleanup_errors=True)
        path = f"{self.files.name}/{uuid.uuid4().hex}"
        v.tofile(path)
        return np.memmap(path, v.dtype, "r")

    def signed(self, v: np.ndarray) -> np.ndarray:
        return -v if len(v) and v[int(np.argmax(np.abs(v)))] < 0 else v

    def scores(self, v: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"node_id": pa.array(self.ids, pa.int64()), "score": pa.array(v, pa.float64())}))

    def close(self) -> None:
        self.blocks.unpersist()
        if self.files is not None:
            self.files.cleanup()
        self.scratch.drop()


def space_of(graph: Graph, direction: str = "out", shift: bool = False, strategy: str = "auto") -> TableSpace | BlockSpace:
    """``auto`` takes blocks where the vertices' number allows it, tables beyond."""
    if strategy not in ("auto", "blocks", "tables"):
        raise ValueError(f"unknown strategy {strategy!r}")
    scratch = Scratch(graph.edges.sparkSession)
    try:
        edges = scratch.table(graph.edges.select(*["src", "dst", "w"][: 2 + graph.weighted]), "edges")
        if strategy != "tables":
            counts = counted_ends(edges, *_ends(direction)).limit(MOST_VERTICES + 1).toArrow()
            if counts.num_rows <= MOST_VERTICES:
                ids, degree = counts.column("id").to_numpy(), counts.column("d").to_numpy()
                order = np.argsort(ids)
                return BlockSpace(edges, graph.weighted, direction, shift, scratch, ids[order].astype(np.int64), degree[order])
            if strategy == "blocks":
                raise ValueError(f"more than {MOST_VERTICES} vertices")
        return TableSpace(edges, graph.weighted, direction, shift, scratch)
    except BaseException:
        scratch.drop()
        raise
