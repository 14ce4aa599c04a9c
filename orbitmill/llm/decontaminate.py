"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A
benchmark item's windows are its runs of ``width`` consecutive words; an item
with fewer words, but not none, is one window. Training documents are scanned
whole: each run of words whose 64-bit hash is in the set is compared with the
item's own words, and a verified run marks its words as hit.

The items' windows are made and put together in Spark, as a table of distinct
windows. The set is broadcast in slices of that table of about ``MOST_WINDOWS``
windows and ``MOST_BYTES`` bytes with their items' ids, by a hash of the window,
so neither the driver nor a task holds more of a benchmark than that, however
large it is; a larger benchmark costs further scans, of a copy of the texts whose
rows are numbered once, by whose numbers the scans are put together.

Defined results: a null or empty text has no words and is clean; items without
words have no window; items that share an item_id are one item; a null item_id
is an item listed as an empty string; repeated documents are each judged alike;
empty tables give no rows, or no hits. Other columns are not read by the
judgement and are passed on by drop_contaminated(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, U64, Scratch, Words, free_name, materialise, packed, slices, utf8

WIDTH = 13
#: Windows of one broadcast slice (about 200 bytes each with their words) and bytes of their words and items' ids, on average.
MOST_WINDOWS, MOST_BYTES = 200_000, 48 << 20
#: Bytes of text handled at once.
PIECE = 1 << 20

HITS = "doc_id long, text_key long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


class WindowSet:
    """Verified look-up of n-gram hashes, for windows of one number of words."""

    def __init__(self, width: int, windows: dict[bytes, list[str]]):
        self.width = width
        grams = [Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), ALNUM) for w in windows]
        keys = np.array([g.grams(g.hashes(), width)[0] for g in grams], U64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        words = list(windows)
        self.words = [words[i] for i in order]
        self.items = [sorted(windows[words[i]]) for i in order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, number of the window) of every verified occurrence."""
        if len(hashes) < self.width or not len(self.keys):
            return
        grams = words.grams(hashes, self.width)
        maybe = np.flatnonzero(self.bits[(grams & U64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, grams[maybe])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == grams[maybe]
        ends = words.first[np.searchsorted(words.first, maybe[hit], "right")]
        for i, k, end in zip(maybe[hit].tolist(), at[hit].tolist(), ends.tolist(), strict=True):
            if i + self.width > end:
                continue
            said = b" ".join(words.bytes[a:b] for a, b in zip(words.start[i : i + self.width].tolist(), words.end[i : i + self.width].tolist(), strict=True))
            while k < len(self.keys) and self.keys[k] == grams[i]:
                if self.words[k] == said:
                    yield i, k
                k += 1


def _windows(width: int):
    """Windows of items (item, text): number of words, the words joined by blanks, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().translate(ALNUM).split()
                n = min(width, len(words))
                last = len(words) - n + 1 if n else 0
                for k in range(0, last, 10_000):
                    found = [b" ".join(words[i : i + n]) for i in range(k, min(last, k + 10_000))]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["n", "said", "item"])

    return run


def window_table(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """n, said, items: the distinct windows of a benchmark and the ids of the items that have them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8("text").alias("t"))
    windows = items.mapInArrow(_windows(width), "n int, said binary, item string")
    return windows.groupBy("n", "said").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scan(sets: list[WindowSet]):
    """Scans the last column, a text; the columns before it are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.schema.names[:-1]
            buf, off = packed(batch.column(batch.num_columns - 1))
            for a, b in slices(off, PIECE):
                words = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM)
                hashes = words.hashes()
                marks: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for s in sets:
                    for i, k in s.find(words, hashes):
                        row = int(np.searchsorted(words.first, i, "right")) - 1
                        at = i - int(words.first[row])
                        marks.setdefault(row, []).append((at, at + s.width))
                        items.setdefault(row, set()).update(s.items[k])
                spans = [_merged(marks[r]) if r in marks else [] for r in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in range(len(known))),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                        pa.array([sorted(items.get(r, ())) for r in range(b - a)], pa.list_(pa.string())),
                    ],
                    [*known, "n_words", "spans", "items"],
                )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Disjoint spans of words (first, last + 1), ascending."""
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def window_sets(windows: DataFrame, most: int = MOST_WINDOWS) -> list[Callable[[], list[WindowSet]]]:
    """Makers of the slices' sets, one at least; each reads its slice to the driver when it is called."""
    size = F.octet_length("said") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i))
    n, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).collect()[0]
    parts = max(1, -(-n // most), -(-n_bytes // MOST_BYTES))

    def make(k: int) -> list[WindowSet]:
        by_width: dict[int, dict[bytes, list[str]]] = {}
        for row in windows.where(F.pmod(F.xxhash64("n", "said"), F.lit(parts)) == k).orderBy("n", "said").toArrow().to_pylist():
            by_width.setdefault(row["n"], {})[row["said"]] = row["items"]
        return [WindowSet(w, x) for w, x in by_width.items()]

    return [lambda k=k: make(k) for k in range(parts)]


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several scans as disjoint spans."""
    for batch in batches:
        spans = [_merged([(s["first"], s["last"]) for s in every]) for every in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), batch.column(4)],
            ["doc_id", "text_key", "n_words", "spans", "items"],
        )


def find_hits(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """One row per document: a hash of its text, its number of words, the hit spans of words, the items found."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), utf8("text").alias("t"))
    with Scratch(documents.sparkSession) as scratch:
        makers = window_sets(scratch.table(window_table(benchmark, width), "windows"), most)
        if len(makers) == 1:
            return docs.mapInArrow(_scan(makers[0]()), HITS)
        return _scanned_by_slices(docs, makers, scratch)


def _scanned_by_slices(docs: DataFrame, makers: list[Callable[[], list[WindowSet]]], scratch: Scratch) -> DataFrame:
    # rows are numbered once and for all, as jobs may split or order the same input differently
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), "*"), "numbered")
    every = [scratch.table(rows.mapInArrow(_scan(make()), f"row long, {HITS}"), "hits") for make in makers]
    union = every[0]
    for part in every[1:]:
        union = union.unionByName(part)
    joined = union.groupBy("row", "doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return materialise(joined.drop("row").mapInArrow(_put_together, HITS), "hits-of-all")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))


def is_contaminated(hit: Column, words: Column) -> Column:
    """At least a twentieth of the words, and one at least."""
    return (hit > 0) & (F.lit(20) * hit >= words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_hits(documents, benchmark, width).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _judge(sets: list[WindowSet]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(sets)
        for batch in batches:
            flags: list[bool] = []
            for part in scan(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column(batch.num_columns - 1)], ["doc_id", "text_key", "t"])])):
                for n, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    hit = sum(s["last"] - s["first"] for s in spans)
                    flags.append(hit > 0 and 20 * hit >= n)
            keep = pa.array([not x for x in flags], pa.bool_())
            yield batch.select(range(batch.num_columns - 1)).filter(keep)

    return run


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """The documents, all their columns, without those that the benchmark contaminates.

    With more than one slice of windows, whether a document is contaminated
    depends on the hits of all slices together; then those found are joined by id
    and a hash of their text.
    """
    with Scratch(documents.sparkSession) as scratch:
        makers = window_sets(scratch.table(window_table(benchmark, width), "windows"), most)
        if len(makers) == 1:
            name = free_name(documents.columns, "text_bytes")
            return documents.withColumn(name, utf8("text")).mapInArrow(_judge(makers[0]()), documents.schema)
    bad = find_hits(documents, benchmark, width, most).withColumn("n_hit", n_hit()).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = materialise(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == bad["bad_key"])
    return documents.join(bad, same, "left_anti")


def drop_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words (first, last + 1), from each span's first letter to its last."""
    data = text.encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at : words.start[a]])
        at = int(words.end[b - 1])
    return b"".join([*keep, data[at:]]).decode()


def remove_spans(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """The documents, all their columns, with the hit spans cut out of their texts instead of dropping documents."""
    hit = materialise(find_hits(documents, benchmark, width, most).where(F.size("spans") > 0).select("text_key", "spans").dropDuplicates(["text_key"]), "hit-spans")
    names = documents.columns
    key, cut = free_name(names, "text_key"), free_name(names, "spans")
    joined = documents.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(hit.toDF(key, cut), key, "left").select(*names, cut)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if t is None or s is None else drop_spans(t, [(x["first"], x["last"]) for x in s])
                for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1])

    return joined.mapInArrow(run, documents.schema)
