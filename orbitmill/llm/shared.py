"""What several operators use: shared scratch tables and word splitting in bulk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, materialise, scratch_path

__all__ = ["Scratch", "materialise", "scratch_path"]

LOWER = "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64


def free_name(names: list[str], like: str) -> str:
    """A column name that isn't among these, whatever the case of letters."""
    taken, out = {n.lower() for n in names}, f"__{like}"
    while out in taken:
        out = f"_{out}"
    return out


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Hands so many rows at a time to Python, for jobs that run inside."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def brief_shuffles(spark: SparkSession):
    """Deletes the shuffle files of each query made inside when it has run, not when the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bits of the bitmap of keys by which rows are split: 2 MB.
KEY_BITS = 24


def _key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of hashed keys (one long column)."""
    places = keys.toDF("key").select(F.shiftrightunsigned("key", 64 - KEY_BITS).alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    out = np.zeros(1 << (KEY_BITS - 5), np.uint32)
    rows = places.groupBy("word").agg(F.bit_or("bit").alias("w")).toArrow()  # one row a word at most
    out[rows.column("word").to_numpy()] = rows.column("w").to_numpy().astype(np.uint32)
    return out


def _split(bitmap, inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy().view(U64) >> U64(64 - KEY_BITS)
            hit = (bitmap.value[(place >> U64(5)).astype(np.int64)] >> (place & U64(31)).astype(np.uint32)) & np.uint32(1) > 0
            yield batch.filter(pa.array(hit if inside else ~hit))

    return run


def split_rows(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among ``keys``, and the others, which an exact join can then sort out.

    The hashed key is the last column. So a join shuffles only rows that may
    match; the bitmap's size is fixed, and the more keys there are the more rows
    go to the join.
    """
    bitmap = keyed.sparkSession.sparkContext.broadcast(_key_bitmap(keys))
    return keyed.mapInArrow(_split(bitmap, False), keyed.schema), keyed.mapInArrow(_split(bitmap, True), keyed.schema)


def utf8(column: str) -> Column:
    """A text column as its UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


# --- words in bulk -----------------------------------------------------------

#: Byte -> lower-cased byte, or a blank outside [0-9A-Za-z] and non-ASCII bytes.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Byte -> lower-cased byte, or a blank for ASCII white space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def packed(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in one array, and where each row starts (one more at the end)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    wide = pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int):
    """Runs of rows (first, last + 1) of at most so many bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of many rows: start and end in `text` (normalised bytes) and, by row, in `first`."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: bytes):
        self.bytes = buf.tobytes().translate(table)
        self.text = np.frombuffer(self.bytes, np.uint8)
        inside = self.text != 32
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.edge = off[(off > 0) & (off < len(inside))]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def apart(self) -> bytes:
        """The text with a blank between rows."""
        return np.insert(self.text, self.edge, 32).tobytes()

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        return span_hashes(self.text, self.start, self.end, base)

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """A hash of the k words from each word on; those that run past the row's end mean nothing."""
        n = max(0, len(hashes) - k + 1)
        out = np.zeros(n, U64)
        for i in range(k):
            out *= U64(0xD6E8FEB86659FD93)
            out += hashes[i : i + n]
        return mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are in the same row."""
        n = max(0, len(self.start) - k + 1)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return row[:n] == row[k - 1 : k - 1 + n]


PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE)
        one, inverse = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        one[0] = inverse[0] = 1
        have = np.multiply.accumulate(one), np.multiply.accumulate(inverse)
        if size == PIECE:
            _powers[base] = have
    return have


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each span text[start:end]; spans ascend and don't overlap. Works in bounded pieces."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + PIECE, "right")))
        b = end[j - 1]
        up, down = powers(base, int(b - a))
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((text[a:b].astype(U64) + U64(1)) * up[: b - a], out=sums[1:])
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mixed(out + (end - start).astype(U64) * U64(0xA0761D6478BD642F))
