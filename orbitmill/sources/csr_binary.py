"""Binary CSR files as a Spark data source, and their writer.

Little-endian: int32 n, int32 nnz, int32 row_ptr[n + 1], int32 col_idx[nnz],
float32 vals[nnz]. Unweighted files may end before vals. Reading splits the
rows; each task reads only its part of each array.

    spark.dataSource.register(CsrBinary)
    spark.read.format("csr_binary").option("path", p).option("weighted", "false").load()
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scratch import Scratch

HEADER = 8
MOST = (1 << 31) - 1
#: Edges handed on at once, and numbers of one piece of a file.
BATCH = 1 << 18


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(path: str, weighted: bool) -> tuple[int, int]:
    """n and nnz; an error if the file is shorter than they say."""
    store, name = open_store(path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    with store.open_input_file(name) as f:
        head = f.read(HEADER)
    if len(head) < HEADER:
        raise ValueError(f"{path}: no header")
    n, nnz = struct.unpack("<ii", head)
    need = HEADER + 4 * (n + 1) + 4 * nnz * (2 if weighted else 1)
    if n < 0 or nnz < 0 or info.size < need:
        raise ValueError(f"{path}: {info.size} bytes, {need} expected")
    return n, nnz


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.weighted = options.get("weighted", "true").lower() == "true"
        self.parts = int(options.get("partitions", "8"))
        self.n, self.nnz = read_header(self.path, self.weighted)

    def partitions(self) -> list[RowRange]:
        cut = np.linspace(0, self.n, min(self.parts, max(1, self.n)) + 1).astype(int).tolist()
        return [RowRange(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        store, name = open_store(self.path)
        with store.open_input_file(name) as f:
            ints = lambda at, k, kind="<i4": np.frombuffer(f.read_at(4 * k, at), kind)
            start = ints(HEADER + 4 * partition.first, partition.last - partition.first + 1)
            col, val = HEADER + 4 * (self.n + 1), HEADER + 4 * (self.n + 1) + 4 * self.nnz
            for a in range(int(start[0]), int(start[-1]), BATCH):
                b = min(a + BATCH, int(start[-1]))
                row = partition.first + np.searchsorted(start, np.arange(a, b), "right") - 1
                w = ints(val + 4 * a, b - a, "<f4").astype(float) if self.weighted else np.ones(b - a)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(ints(col + 4 * a, b - a).astype(np.int64)), pa.array(w)], ["src", "dst", "w"])


class CsrBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr_binary"

    def schema(self) -> str:
        return "src long, dst long, w double"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, weighted: bool = True, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(CsrBinary)
    return spark.read.format("csr_binary").option("path", path).option("weighted", str(weighted).lower()).option("partitions", str(partitions)).load()


def write_csr(rows: DataFrame, columns: DataFrame, path: str, weighted: bool = True) -> tuple[int, int]:
    """Writes one file from rows (idx, row_start, degree) and columns (pos, col_idx, w); returns n and nnz.

    Tasks make the arrays' bytes in pieces; the file's one writer only puts these
    in order, a few MB at a time.
    """
    with Scratch(rows.sparkSession) as scratch:
        starts, n = _pieces(rows, "idx", {"a": F.col("row_start").cast("long")}, scratch)
        numbers = {"a": F.col("col_idx").cast("int"), **({"w": F.col("w").cast("float")} if weighted else {})}
        edges, nnz = _pieces(columns, "pos", numbers, scratch)
        if max(n, nnz) > MOST:
            raise ValueError("the format's numbers have 32 bits")
        store, name = open_store(path)
        with store.open_output_stream(name) as out:
            out.write(struct.pack("<ii", n, nnz))
            for part in _in_order(starts, "a", n):
                out.write(part)
            out.write(struct.pack("<i", nnz))
            for part in _in_order(edges, "a", nnz):
                out.write(part)
            if weighted:
                for part in _in_order(edges, "w", nnz):
                    out.write(part)
    return n, nnz


def _piece(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("at").to_numpy(), kind="stable")
    data = lambda c, kind: [rows.column(c).to_numpy()[order].astype(kind).tobytes()] if c in rows.column_names else [None]
    return pa.table({"piece": rows.column("piece").slice(0, 1), "n": pa.array([len(order)], pa.int64()), "a": pa.array(data("a", "<i4"), pa.binary()), "w": pa.array(data("w", "<f4"), pa.binary())})


def _pieces(df: DataFrame, order: str, values: dict[str, Column], scratch: Scratch) -> tuple[DataFrame, int]:
    """A table of pieces of BATCH values as bytes, in order within a piece, and the number of values."""
    at = F.col(order).cast("long")
    each = df.select(F.floor(at / F.lit(BATCH)).cast("long").alias("piece"), at.alias("at"), *[v.alias(k) for k, v in values.items()])
    made = scratch.table(each.groupBy("piece").applyInArrow(_piece, "piece long, n long, a binary, w binary"), "csr-pieces")
    return made, made.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def _in_order(pieces: DataFrame, column: str, total: int) -> Iterator[bytes]:
    """The pieces' bytes in order, eight pieces of them at a time."""
    parts = max(1, -(-total // (8 * BATCH)))
    for row in pieces.select("piece", column).repartitionByRange(parts, "piece").sortWithinPartitions("piece").toLocalIterator():
        yield bytes(row[column])
