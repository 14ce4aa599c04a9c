"""SimHash near-duplicates by pigeonhole blocks.

Text is lower-cased (A-Z), split at ASCII white space and cut into shingles of
``width`` words, repeats included; a text with fewer words is one shingle, one
without words has fingerprint zero. Each fingerprint bit is the majority of the
same bit of the shingles' XXH64 (seed 42). Equal fingerprints are one class
from the start. Fingerprints are cut into ``blocks`` blocks: those that differ
in at most ``distance`` bits agree in ``blocks - distance`` blocks at least, so
classes meet in the bucket of every choice of that many blocks, in tasks of
bounded size, and each candidate pair's Hamming distance is verified.

Defined results: null text is an empty text; texts without words link with each
other; repeated rows come out once each, with the same answer; a null doc_id
never lowers a component's id (a component of null ids only has id null); an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import chunk_pairs, components, forest, linked_pairs
from .shared import SPACED, U64, Scratch, Words, free_name, materialise, packed, slices, split_rows, utf8

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = 4
PIECE = 1 << 20


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            buf, off = packed(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(off, PIECE):
                words = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a], SPACED)
                # words with one blank between, so that a shingle is a slice
                length = words.end - words.start
                joined = b" ".join(words.apart().split())
                start = np.zeros(len(length) + 1, np.int64)
                np.cumsum(length + 1, out=start[1:])
                end = start[1:] - 1
                for r in range(b - a):
                    i, j = int(words.first[r]), int(words.first[r + 1])
                    if i == j:
                        continue
                    if j - i < width:
                        spans = [(int(start[i]), int(end[j - 1]))]
                    else:
                        spans = zip(start[i : j - width + 1].tolist(), end[i + width - 1 : j].tolist(), strict=True)
                    out[a + r] = np.array(fingerprint(np.array([digest(joined[x:y], SEED) for x, y in spans], U64)), U64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), a row per document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def block_keys(blocks: int, distance: int) -> list[int]:
    """Masks, one for each choice of blocks that a close pair may agree in."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def _close(distance: int):
    """Links within one chunk, or between the two chunks of a pair (whose own links their own tasks find)."""

    def found(rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(U64)
        rep = rows.column("rep").to_numpy()
        order = np.lexsort((fp, rep))
        fp, rep = fp[order], rep[order]
        ci, cj, side = (rows.column(c).to_numpy()[order] for c in ("ci", "cj", "side"))
        one = np.flatnonzero(side == ci[0])
        other = one if ci[0] == cj[0] else np.flatnonzero(side == cj[0])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(one), 256):
            far = np.bitwise_count(fp[one[k : k + 256], None] ^ fp[None, other])
            a, b = np.nonzero(far <= distance)
            a, b = one[a + k], other[b]
            apart = a != b
            left.append(a[apart])
            right.append(b[apart])
        low = forest(len(fp), (np.concatenate(left), np.concatenate(right)))
        tied = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": pa.array(rep[low[tied]], pa.int64()), "b": pa.array(rep[tied], pa.int64())})

    return found


def close_links(classes: DataFrame, scratch: Scratch, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between representatives that span every set of fingerprints linked within ``distance`` bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(block_keys(blocks, distance))])
    members = classes.select("fp", "rep", F.explode(masks).alias("m")).select("fp", "rep", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("part"))
    chunked = chunk_pairs(members, ["choice", "part"], "fp", scratch)
    return linked_pairs(chunked, ["choice", "part"], _close(distance), "a long, b long")


def _groups(prints: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """fp, least (its least doc_id), root (its component's) of every fingerprint."""
    # the class number is its place among ids; ids may be null or repeated, fingerprints are not
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    by_print = components(close_links(classes.select("fp", F.col("fp").alias("rep")), scratch, distance), scratch, "simhash")
    group = classes.join(by_print, classes["fp"] == by_print["node"], "left").select(classes["fp"], "least", F.coalesce("component", classes["fp"]).alias("root"))
    return scratch.table(group, "simhash-groups")


def simhash_components(documents: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), one row per document."""
    prints = materialise(fingerprints(documents, width), "simhash-fp")
    with Scratch(documents.sparkSession) as scratch:
        group = _groups(prints, distance, scratch)
        least = scratch.table(group.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
        named = materialise(group.join(least, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _text_key() -> Column:
    """128 bits of a text, as two numbers in a struct."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("b")).alias("b"))


def keep_each(documents: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """The documents, all their columns, one of each component: that with the least doc_id, then hash of its text.

    Null doc_ids come last. Of rows equal in doc_id and text the least by the
    hash of all their columns stays; if that is equal too, so are they.
    """
    doc_id = F.col("doc_id").cast("long")
    names = documents.columns
    text, key, same_row = (free_name(names, x) for x in ("text", "key", "row"))
    with Scratch(documents.sparkSession) as scratch:
        texts = documents.select(doc_id.alias("doc_id"), _text_key().alias("text_key"), utf8("text").alias("t"))
        prints = scratch.table(texts.mapInArrow(_fingerprints(width), "doc_id long, text_key struct<a:long,b:long>, fp long"), "simhash-fp")
        found = scratch.table(prints.join(_groups(prints, distance, scratch).select("fp", "root"), "fp").select("doc_id", "text_key", "root"), "simhash-found")
        first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("f"))
        first = scratch.table(first.select(F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("first_key")), "simhash-first")
        copies = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
        judged = copies.join(first, copies["doc_id"].eqNullSafe(first["first_id"]) & (copies["text_key"] == first["first_key"]), "left")
        stays = F.col("first_key").isNotNull()
        asked = materialise(judged.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("asked_id"), F.col("text_key").alias("asked_key"), stays.alias("stays")), "simhash-asked")
    # only documents that may go are shuffled
    stay, rest = split_rows(documents.withColumn(text, _text_key()).withColumn(key, F.xxhash64(doc_id, text)), asked.select(F.xxhash64("asked_id", "asked_key")))
    same = doc_id.eqNullSafe(F.col("asked_id")) & (F.col(text) == F.col("asked_key"))
    kept = stay.unionByName(rest.join(asked.drop("stays"), same, "left_anti")).select(*names)
    several = asked.where("stays").drop("stays")
    if several.isEmpty():
        return kept
    # whole columns as text: all types have one
    one = rest.join(several, same, "left_semi").withColumn(same_row, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names if c != text]))
    order = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(same_row))
    return kept.unionByName(one.withColumn(key, order).where(F.col(key) == 1).select(*names))
