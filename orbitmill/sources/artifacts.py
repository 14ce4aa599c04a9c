"""Files around a run: CSR arrays as text, metadata, scores, top-k tables and metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import fixed_decimals
from ..functions.scratch import materialise
from ..operators.centrality import Result
from ..operators.graph import csr_checks
from ..operators.ranking import ranked, top_k
from ..operators.stats import graph_summary
from .csr_binary import write_csr

METADATA = "num_nodes long, num_edges long, indptr_length long, indices_length long, data_length long, input_file string"
METRICS = (
    "dataset string, num_nodes long, num_edges long, nnz long, method string, max_iter long, tol double, iterations long, "
    "runtime_seconds double, avg_iteration_ms double, edges_per_second double, residual double, converged boolean, "
    "top_node long, top_score double, score_sum double, top_k long, graph_type string, density double, avg_degree double, "
    "max_degree long, min_degree long, csr_mb double, gflops double, gigabytes_per_second double, input_file string, csr_file string"
)
SCORES = "node_id long, score double"
TOP = "rank long, node_id long, score double"


def _split_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block) as (file, block, first, numbers): the numbers of some lines of one split, and how many it has before them."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        name, block = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        cut = np.flatnonzero((np.diff(name) != 0) | (np.diff(block) != 0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = batch.column("file")[i].as_py(), int(block[i])
            found = "\n".join(batch.column("value").slice(i, j - i).to_pylist()).encode().split()
            first = seen.get(key, 0)
            seen[key] = first + len(found)
            numbers = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), numbers], ["file", "block", "first", "numbers"])


def read_array(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(pos, value) of a text file of numbers, in the file's order, or of a folder's files one after another by name.

    Splits are read side by side and moved by the numbers in the splits before them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = materialise(lines.mapInArrow(_split_numbers, "file string, block long, first long, numbers array<string>"), "numbers")
    totals = pieces.groupBy("file", "block").agg(F.sum(F.size("numbers")).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    each = pieces.join(F.broadcast(moved), ["file", "block"]).select((F.col("moved") + F.col("first")).alias("at"), F.posexplode("numbers").alias("i", "v"))
    return each.select((F.col("at") + F.col("i")).cast("long").alias("pos"), F.col("v").cast("double").cast(kind).alias("value"))


def write_array(values: DataFrame, path: str) -> None:
    """Writes (pos, value) by pos, a number a line, to a folder's files one after another by name."""
    values.orderBy("pos").select(F.col("value").cast("string")).write.mode("overwrite").text(path)


def csr_from_arrays(indptr: DataFrame, indices: DataFrame, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (idx, row_start, degree) and columns (pos, col_idx, w) from three arrays (pos, value)."""
    following = indptr.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    # sizes of compressed numbers are estimated too low to broadcast by
    rows = indptr.hint("merge").join(following, "pos").select(F.col("pos").alias("idx"), F.col("value").alias("row_start"), (F.col("end") - F.col("value")).alias("degree"))
    columns = indices.select("pos", F.col("value").alias("col_idx"))
    if data is None:
        return rows, columns.withColumn("w", F.lit(1.0))
    return rows, columns.hint("merge").join(data.select("pos", F.col("value").cast("double").alias("w")), "pos")


def pack(spark: SparkSession, indptr: str, indices: str, target: str, data: str | None = None) -> tuple[int, int]:
    """Packs CSR arrays in text files into a binary CSR file, if they fit together; returns n and nnz."""
    read = lambda path, kind="long": materialise(read_array(spark, path, kind), "array")
    starts, ends, weights = read(indptr), read(indices), None if data is None else read(data, "double")
    if weights is not None and weights.count() != ends.count():
        raise ValueError(f"{data}: not one number for each of {indices}")
    rows, columns = csr_from_arrays(starts, ends, weights)
    broken = rows.where("degree < 0 or (idx = 0 and row_start <> 0)").limit(1).count() + ends.where("value < 0").limit(1).count()
    checks = csr_checks(rows, columns).collect()[0]
    if broken or not checks["valid"]:
        raise ValueError(f"{indptr}, {indices}: {checks['n']} rows end at {checks['end']} of {checks['nnz']} columns, or a number is out of range")
    return write_csr(rows, columns, target)


def write_metadata(spark: SparkSession, path: str, n: int, nnz: int, input_file: str) -> None:
    spark.createDataFrame([(n, nnz, n + 1, nnz, nnz, input_file)], METADATA).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_scores(scores: DataFrame, path: str, header: tuple[str, str] = ("node_id", "score"), by_score: bool = True, digits: int | None = None) -> None:
    """Scores as one CSV file, by score or by node, with the header and decimals asked for."""
    ordered = ranked(scores) if by_score else scores.orderBy("node_id")
    value = F.col("score") if digits is None else fixed_decimals(F.col("score"), digits)
    write_csv(ordered.coalesce(1).select(F.col("node_id").alias(header[0]), value.alias(header[1])), path)


def write_top(scores: DataFrame, path: str, k: int = 20) -> None:
    write_csv(top_k(scores, k).coalesce(1), path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def metrics_row(
    spark: SparkSession, result: Result, dataset: str, edges: DataFrame, method: str, max_iter: int, tol: float,
    directed: bool = False, k: int = 20, input_file: str | None = None, csr_file: str | None = None,
) -> DataFrame:
    """One row of METRICS; an empty graph has no top node."""
    top = top_k(result.scores, 1).collect()
    total = result.scores.agg(F.sum("score")).collect()[0][0]
    graph = graph_summary(edges).collect()[0]
    nnz = graph["nnz"]
    row = (
        dataset, result.n, nnz if directed else nnz // 2, nnz, method, max_iter, tol, result.iterations, result.runtime_seconds,
        1e3 * result.seconds_per_iteration, result.edges_per_second(nnz), result.residual, result.converged,
        top[0]["node_id"] if top else None, top[0]["score"] if top else None, total, k, "directed" if directed else "undirected",
        graph["density"], graph["avg_degree"], graph["max_degree"], graph["min_degree"], graph["csr_mb"],
        result.gflops(nnz), result.gigabytes_per_second(nnz), input_file, csr_file,
    )
    return spark.createDataFrame([row], METRICS)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def dataset_name(path: str) -> str:
    """The file's name without .csr.bin or its last extension."""
    name = PurePosixPath(path).name
    if name.endswith(".csr.bin"):
        return name[: -len(".csr.bin")]
    return name.rpartition(".")[0] or name


@dataclass(frozen=True)
class OutputPaths:
    scores: str
    top: str
    metrics: str

    @classmethod
    def of(cls, folder: str, dataset: str, k: int = 20) -> OutputPaths:
        base = f"{folder.rstrip('/')}/{dataset}"
        return cls(f"{base}_eigenvector_scores.csv", f"{base}_top{k}.csv", f"{base}_metrics.json")


def csr_name(path: str) -> str:
    """A CSR file's name; .csr.bin becomes .csr."""
    return path[: -len(".bin")] if path.endswith(".csr.bin") else path


def report(result: Result, k: int = 20) -> str:
    """Top nodes and figures of a run as text."""
    lines = [f"{'rank':>6} {'node':>12} {'score':>12}"]
    lines += [f"{r['rank']:>6} {r['node_id']:>12} {r['score']:>12.8f}" for r in top_k(result.scores, k).collect()]
    lines.append(f"vertices {result.n}, iterations {result.iterations}, converged {result.converged}, residual {result.residual:.3e}")
    lines.append(f"{result.runtime_seconds:.3f} s, {1e3 * result.seconds_per_iteration:.2f} ms an iteration")
    return "\n".join(lines)
