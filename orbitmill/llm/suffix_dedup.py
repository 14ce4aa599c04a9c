"""Removal of byte strings that an earlier document has, by suffix sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in
a document with a smaller doc_id. Texts are whole UTF-8 texts; matches never
cross documents.

Every window of ``LENGTH`` bytes is assigned to the least hash among the grams
of ``GRAM`` bytes in it, so equal windows are assigned alike wherever they
stand. Neighbouring windows with the same hash make a segment (of ``WINDOWS``
windows at most; a longer run makes several), and a run of segments up to the
next one whose hash ends in ``CUT_BITS`` zeros a stretch. A window that stands
in several documents is always kept in the first of them by what follows, so
settling copies early never hides a match.

1. A bitmap of fixed size holds the stretches that several documents have; every
   distinct stretch that hits it is noted with its least document in another. A
   stretch that hits the first and isn't noted with its document is a copy of an
   earlier document's: it is removed where the text lies, which settles most of
   what copies and near copies share. A chance hit only leaves it to later steps.
2. A third bitmap holds the hashes that occur in two documents or more among
   the segments left, made from packed hashes, four bytes each. It only spares
   work: a wrong hit costs time, a hash that repeats is never missed.
3. Segments whose hash may repeat are told apart by their digests, as narrow
   rows with partial aggregation; those of hashes that several documents have are
   noted with their least document as in 1: again, what isn't noted is removed
   where the text lies.
4. What is left of a hash that several documents have is settled once more by
   its digests, if it isn't alone there: copies that hit the bitmap by chance are
   found among the few segments left. The others go, with their bytes and their
   places, to parts by hash, if they aren't alone there; each part's hashes are
   suffix-sorted in two stages, ``SORT_BYTES`` of whole hashes at a time, and
   windows with an adjacent common prefix of ``LENGTH`` bytes share their least
   document. A hash with more than ``MOST_SEGMENTS`` segments would
   overfill a part; its windows are sorted by Spark, by their own bytes.
5. Ranges to remove go back to their documents; only the texts of documents
   that may have some are shuffled.

The bitmaps have 2**BITS bits at most. Where an input has far more distinct
stretches or hashes than bits, they spare less work and the result is the same.
Equal stretches and segments are known by 128-bit BLAKE2b digests of their
bytes, for which no collision can be made; the hashes of grams only deal work.

Defined results: null text is an empty text; texts of under LENGTH bytes are
kept whole; a null doc_id counts as larger than all others; rows that share a
doc_id don't remove from each other; equal rows come out once each; an empty
table gives no rows. Other columns are not read by the report and are passed on
by remove_repeats(), whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U64, Scratch, arrow_rows, brief_shuffles, free_name, materialise, mixed, packed, powers, slices, split_rows, utf8
from .suffix_sort import least_by_window

LENGTH, GRAM = 50, 28
#: Windows of one segment at most.
WINDOWS = 256
#: Bytes of text scanned at once; a longer text is cut, its windows are not.
PIECE = 1 << 19
#: A stretch ends before a segment whose hash ends in so many zeros.
CUT_BITS = 3
#: Bits of a bitmap at most (32 MB), as a power of two; fewer for texts of less than 8 bytes for each.
BITS = 28
#: Rows handed to Python at a time.
ROWS = 1000
#: Bytes of segments in one part.
PART_BYTES = 4 << 20
#: Of these, so many are sorted at a time.
SORT_BYTES = 1 << 20
MOST_SEGMENTS = 20_000
LAST = (1 << 63) - 1
_BASE = 0x5851F42D4C957F2D


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) numbers: the BLAKE2b digests, of 128 bits, of data[start:end]."""
    made = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)


class Segments:
    """Segments of the rows of one piece: hash, row, first byte in the piece, length in bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int, gram: int):
        n = len(buf)
        empty = np.empty(0, np.int64)
        self.hash, self.row, self.start, self.size = np.empty(0, U64), empty, empty, empty
        if n < length:
            return
        up, down = powers(_BASE, n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        least = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        width, have = length - gram + 1, 1
        while have < width:  # the least of `have` neighbours grows to that of `width`
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: n - length + 1]
        place = np.flatnonzero(np.arange(len(row)) + length <= off[row + 1])
        value, owner = least[place], row[place]
        new = np.ones(len(place), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place)))
        if len(count) and count.max() > WINDOWS:
            parts = -(-count // WINDOWS)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + step * WINDOWS
            count = np.diff(np.append(first, len(place)))
        # least values crowd at the low end: mixed again, their leading bits fill a bitmap and deal parts evenly
        self.hash, self.row, self.start = mixed(value[first]), owner[first], place[first]
        self.size = count + length - 1

    def stretches(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first byte, end and digest (two numbers) of every stretch, and the stretch of each segment."""
        if not len(self.hash):
            return self.row, self.start, self.size, np.empty((0, 2), U64), self.row
        new = np.ones(len(self.hash), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | ((self.hash[1:] & U64((1 << CUT_BITS) - 1)) == 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        start, end = self.start[first], self.start[last] + self.size[last]
        return self.row[first], start, end, digests(data, start, end), np.cumsum(new) - 1

    def take(self, keep: np.ndarray) -> None:
        self.hash, self.row, self.start, self.size = self.hash[keep], self.row[keep], self.start[keep], self.size[keep]


def pieces(values: pa.Array, length: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, rows and first bytes within their rows, piece by piece; long rows are cut between windows."""
    buf, off = packed(values)
    rows, at, size = [], [], 0
    cuts = []
    for r in range(len(off) - 1):
        n = int(off[r + 1] - off[r])
        for base in range(0, max(n - length + 1, 0), piece):
            m = min(piece + length - 1, n - base)
            if rows and size + m > piece:
                cuts.append((rows, at))
                rows, at, size = [], [], 0
            rows.append((r, base, m))
            at.append(off[r] + base)
            size += m
    if rows:
        cuts.append((rows, at))
    for rows, at in cuts:
        r, base, m = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        edge = np.concatenate([[0], np.cumsum(m)])
        yield np.concatenate([buf[a : a + k] for a, k in zip(at, m, strict=True)]), edge, r, base


def noted(keys: np.ndarray, doc: np.ndarray, turn: int = 0) -> np.ndarray:
    """The hash by which the document of a digest (two numbers) is noted; another one in each turn."""
    return mixed(keys[:, 0] ^ mixed(keys[:, 1] + U64(turn) + mixed(doc.astype(np.int64).view(U64))))


def _left(batch: pa.RecordBatch, length: int, gram: int, shared: Bitmap, firsts: Bitmap) -> Iterator[tuple]:
    """By piece of a batch (doc, text_key, text): its segments, which of them are in copied stretches, bytes, doc and text_key of its rows, shift."""
    doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for buf, off, rows, base in pieces(batch.column(2), length):
        s, data = Segments(buf, off, length, gram), buf.tobytes()
        row, _, _, keys, of = s.stretches(data)
        copied = shared.has(keys[:, 0])
        copied[copied] = ~firsts.has(noted(keys[copied], doc[rows[row[copied]]]))
        yield s, copied[of], data, doc[rows], key[rows], base - off[:-1]


def packed_parts(hashes: np.ndarray, part_bits: int) -> pa.RecordBatch:
    """Hashes by their leading bits, of the others the first four bytes."""
    part = (hashes >> U64(64 - part_bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rest = ((hashes >> U64(32 - part_bits)) & U64(0xFFFFFFFF)).astype("<u4")[order]
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    parts = np.split(rest, cut)
    return pa.RecordBatch.from_arrays([pa.array(part[np.concatenate([[0], cut])], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "hashes"])


class Bitmap:
    """A broadcast set of leading bits of hashes; its parts (number and bytes) are compressed where they are made and unpacked once in a worker."""

    _held: ClassVar[dict[str, np.ndarray]] = {}

    def __init__(self, spark: SparkSession, bits: int, part_bits: int, parts: list[tuple[int, bytes]]):
        self.bits, self.size = bits, 1 << (bits - part_bits - 3)
        self.name = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast(parts)

    def unpacked(self) -> np.ndarray:
        out, unpack = np.zeros(1 << (self.bits - 3), np.uint8), zstandard.ZstdDecompressor()
        for part, data in self.sent.value:
            out[part * self.size : (part + 1) * self.size] = np.frombuffer(unpack.decompress(data), np.uint8)
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bitmap = self._held.get(self.name)
        if bitmap is None:
            while len(self._held) >= 4:  # of an earlier job
                del self._held[next(iter(self._held))]
            bitmap = self._held[self.name] = self.unpacked()
        place = hashes >> U64(64 - self.bits)
        return (bitmap[(place >> U64(3)).astype(np.int64)] >> (np.uint8(7) - (place & U64(7)).astype(np.uint8))) & np.uint8(1) > 0

    def destroy(self) -> None:
        self.sent.destroy()


def _gathered(hashes: Iterator[np.ndarray], part_bits: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= most:
            yield packed_parts(np.concatenate(held), part_bits)
            held, n = [], 0
    if n:
        yield packed_parts(np.concatenate(held), part_bits)


def _numbers(batch: pa.RecordBatch, *columns: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(U64) for c in columns], axis=1)


def _noted(part_bits: int, among: Bitmap, turn: int = 0):
    """Packs what is noted of rows (hash, k1, k2, doc) whose hash is among these."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            b = batch.filter(pa.array(among.has(batch.column(0).to_numpy().view(U64))))
            yield noted(_numbers(b, 1, 2), b.column(3).to_numpy(), turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(found(batches), part_bits)

    return run


def _plain(part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((b.column(0).to_numpy().view(U64) for b in batches), part_bits)

    return run


def _hashes(length: int, gram: int, part_bits: int, shared, firsts):
    """Hashes of segments: once for each piece they occur in, twice if in two rows of it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for s, copied, *_ in _left(batch, length, gram, shared, firsts):
                s.take(~copied)
                order = np.lexsort((s.row, s.hash))
                h, row = s.hash[order], s.row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                first = np.flatnonzero(new)
                if len(first):
                    last = np.append(first[1:], len(h)) - 1
                    yield h[first]
                    yield h[first][row[first] != row[last]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(found(batches), part_bits)

    return run


def _bits(part_bits: int, bits: int, least: int):
    """The part's slice of the bitmap, compressed: places of hashes that came ``least`` times (1 or 2) or more."""

    def run(rows: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in rows.column("hashes")])
        if least == 2:
            every.sort()
            every = every[1:][every[1:] == every[:-1]]
        found = np.zeros(1 << (bits - part_bits), bool)
        found[every >> np.uint32(32 - bits + part_bits)] = True
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int64()), "bitmap": pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(found).tobytes())], pa.binary())})

    return run


PACKED = "part long, hashes binary"


def bits_for(total: int) -> int:
    """Bits of the bitmaps for so many bytes of text, as a power of two."""
    return min(max(20, int(np.ceil(np.log2(max(total, 1) / 8)))), BITS)


def part_bits_for(total: int, bits: int) -> int:
    """So many parts that the hashes of 16 MB of text make one."""
    return min(max(6, int(np.ceil(np.log2(max(total, 1) / (16 << 20))))), bits - 6)


def bitmap_of(hashes: DataFrame, part_bits: int, bits: int, least: int) -> Bitmap:
    """The leading ``bits`` of packed hashes that came ``least`` times or more."""
    slices = hashes.groupBy("part").applyInArrow(_bits(part_bits, bits, least), "part long, bitmap binary")
    # the bitmap's own size in all at most
    return Bitmap(hashes.sparkSession, bits, part_bits, [(r["part"], bytes(r["bitmap"])) for r in slices.collect()])


def _stretch_keys(length: int, gram: int):
    """Stretches of every text: (k1, k2, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for buf, off, rows, _ in pieces(batch.column(1), length):
                row, _, _, keys, _ = Segments(buf, off, length, gram).stretches(buf.tobytes())
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T.astype(np.int64)), pa.array(doc[rows[row]])], ["k1", "k2", "doc"])

    return run


def _segment_keys(length: int, gram: int, shared, firsts, repeated):
    """Segments outside copied stretches whose hash may repeat: (hash, k1, k2, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, copied, data, doc, _, _ in _left(batch, length, gram, shared, firsts):
                s.take(~copied & repeated.has(s.hash))
                keys = digests(data, s.start, s.start + s.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.hash.view(np.int64)), *map(pa.array, keys.T.astype(np.int64)), pa.array(doc[s.row])], ["hash", "k1", "k2", "doc"])

    return run


SETTLED = "doc long, text_key long, a long, b long, hash long, segment binary"
_SETTLED = ["doc", "text_key", "a", "b", "hash", "segment"]


def _settled(length: int, gram: int, shared, firsts, several, own):
    """Ranges that copied stretches and segments cover (without a segment), and segments to sort with their place and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, copied, data, doc, key, shift in _left(batch, length, gram, shared, firsts):
                end = s.start + s.size
                asked = np.flatnonzero(~copied & several.has(s.hash))
                known = own.has(noted(digests(data, s.start[asked], end[asked]), doc[s.row[asked]]))
                copied[asked[~known]] = True
                asked = asked[known]
                # copied segments of a row that touch make one range
                at = np.flatnonzero(copied)
                new = np.ones(len(at), bool)
                new[1:] = (s.row[at][1:] != s.row[at][:-1]) | (s.start[at][1:] > end[at][:-1])
                one = np.flatnonzero(new)
                first, last = at[one], at[np.append(one[1:], len(at)) - 1] if len(at) else at
                told = np.concatenate([first, asked])
                row = s.row[told]
                sorts = np.arange(len(told)) >= len(first)
                upto = np.concatenate([end[last], end[asked]])
                texts = [None] * len(first) + [data[a:b] for a, b in zip(s.start[asked].tolist(), end[asked].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[row]),
                        pa.array(key[row]),
                        pa.array(s.start[told] + shift[row]),
                        pa.array(upto + shift[row]),
                        pa.array(s.hash[told].view(np.int64), mask=~sorts),
                        pa.array(texts, pa.binary()),
                    ],
                    _SETTLED,
                )

    return run


def _asked(batches: Iterator[pa.RecordBatch], among: Bitmap) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of SETTLED with a segment whose hash is among these, and the segments' digests."""
    for batch in batches:
        batch = batch.filter(pa.array(among.has(batch.column("hash").to_numpy().view(U64))))
        buf, off = packed(batch.column("segment"))
        yield batch, digests(buf.tobytes(), off[:-1], off[1:])


def _asked_keys(among: Bitmap):
    """Of segments to sort: (hash, k1, k2, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys in _asked(batches, among):
            yield pa.RecordBatch.from_arrays([rows.column("hash"), *map(pa.array, keys.T.astype(np.int64)), rows.column("doc")], ["hash", "k1", "k2", "doc"])

    return run


def _settled_again(among: Bitmap, own: Bitmap, turn: int):
    """Segments to sort that aren't noted become ranges, as in _settled; those that are alone go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys in _asked(batches, among):
            copied = pa.array(~own.has(noted(keys, rows.column("doc").to_numpy(), turn)))
            bare = [pc.if_else(copied, pa.scalar(None, c.type), c) for c in (rows.column("hash"), rows.column("segment"))]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], *bare], _SETTLED)

    return run


def _having(hashes: Bitmap):
    """Keeps the rows whose ``hash`` is among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hashes.has(batch.column("hash").to_numpy().view(U64))))

    return run


RANGES = "doc long, text_key long, a long, b long"


def _sorted_parts(length: int, most: int = SORT_BYTES):
    """Ranges of segments (doc, text_key, a, hash, segment) that hold windows which an earlier document has.

    A task has all segments of its hashes, about PART_BYTES of them. Windows
    meet within their hash only, so whole hashes are sorted, ``most`` bytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        del held
        _, of, count = np.unique(rows.column("hash").to_numpy(), return_inverse=True, return_counts=True)
        rows = rows.filter(pa.array(count[of] > 1))  # a hash with one segment has no other to share windows with
        if not rows.num_rows:
            return
        rows = rows.sort_by("hash").combine_chunks()
        hashes = rows.column("hash").to_numpy()
        group = np.concatenate([[0], np.flatnonzero(np.diff(hashes)) + 1, [len(hashes)]])
        off = packed(rows.column("segment"))[1]
        for i, j in slices(off[group], most):
            found = _shared_windows(rows.slice(group[i], group[j] - group[i]), length)
            if found is not None:
                yield found

    return run


def _shared_windows(rows: pa.Table, length: int) -> pa.RecordBatch | None:
    """The ranges (doc, text_key, a, b) among these segments, if there are some."""
    buf, off = packed(rows.column("segment"))
    doc = rows.column("doc").to_numpy()
    least, edge = least_by_window(buf, off, doc, length)
    hit = np.flatnonzero(least < np.repeat(doc, np.diff(edge)))
    if not len(hit):
        return None
    of = np.searchsorted(edge, hit, "right") - 1
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (np.diff(of) > 0)
    first = np.flatnonzero(new)
    of, last = of[first], np.append(first[1:], len(hit)) - 1
    start = rows.column("a").to_numpy()[of] - edge[of]
    columns = [doc[of], rows.column("text_key").to_numpy()[of], start + hit[first], start + hit[last] + length]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "text_key", "a", "b"])


def _crowded(crowd: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """What _sorted_parts finds, for segments of hashes with too many: windows meet by their bytes."""
    each = crowd.withColumn("i", F.explode(F.expr(f"sequence(0, octet_length(segment) - {length})"))).withColumn("window", F.expr(f"substring(segment, i + 1, {length})"))
    first = each.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "least")
    # a table of its own, so that a hot window's places can be split among join tasks
    hit = each.join(scratch.table(first, "crowded-windows"), "window").where("least < doc")
    return hit.select("doc", "text_key", (F.col("a") + F.col("i")).alias("a"), (F.col("a") + F.col("i") + length).alias("b"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_key(F.col("text")).alias("text_key"), utf8("text").alias("t"))


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """doc, text_key, spans: byte spans (a, b) to remove, of the documents that have some; spans may overlap."""
    spark = documents.sparkSession
    with arrow_rows(spark, ROWS), brief_shuffles(spark), Scratch(spark) as scratch:
        return materialise(_removals(_keyed(documents), length, gram, most_segments, scratch), "removals")


def _removals(docs: DataFrame, length: int, gram: int, most_segments: int, scratch: Scratch) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    bits = bits_for(total)
    part_bits = part_bits_for(total, bits)
    bitmap = lambda rows, pack, least=1: bitmap_of(rows.mapInArrow(pack, PACKED), part_bits, bits, least)

    stretches = docs.select("doc", "t").mapInArrow(_stretch_keys(length, gram), "k1 long, k2 long, doc long")
    stretches = scratch.table(stretches.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.max("doc").alias("most")), "distinct-stretches", "keys")
    shared = bitmap(stretches.where("doc < most").select("k1"), _plain(part_bits))
    firsts = bitmap(stretches.select(F.col("k1").alias("hash"), "k1", "k2", "doc"), _noted(part_bits, shared))
    scratch.drop("keys")

    repeated = bitmap(docs, _hashes(length, gram, part_bits, shared, firsts), 2)

    segments = docs.mapInArrow(_segment_keys(length, gram, shared, firsts, repeated), "hash long, k1 long, k2 long, doc long")
    distinct = scratch.table(segments.groupBy("hash", "k1", "k2").agg(F.min("doc").alias("doc"), F.max("doc").alias("most")), "distinct-segments", "keys")
    repeated.destroy()
    # also where there is one segment with copies: a copy that hits ``own`` by chance is sorted beside its first
    several = distinct.groupBy("hash").agg(F.min("doc").alias("least"), F.max("most").alias("most")).where("least < most")
    # it has bits that ``repeated`` has, so all segments that hit it are among the distinct ones
    several = bitmap(several.select("hash"), _plain(part_bits))
    own = bitmap(distinct.select("hash", "k1", "k2", "doc"), _noted(part_bits, several))
    scratch.drop("keys")

    settled = scratch.table(docs.mapInArrow(_settled(length, gram, shared, firsts, several, own), SETTLED), "settled")
    for used in (shared, firsts, several, own):
        used.destroy()
    ranges = settled.where("segment is null").select("doc", "text_key", "a", "b")
    asked = settled.where("segment is not null")
    # most firsts are alone now, as their copies are settled: their bytes stay where they are
    met = bitmap(asked.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), _plain(part_bits))
    # copies that hit ``own`` by chance are left: far fewer firsts are noted now, so nearly all of them are settled
    left = asked.mapInArrow(_asked_keys(met), "hash long, k1 long, k2 long, doc long").groupBy("hash", "k1", "k2").agg(F.min("doc").alias("doc"))
    own = bitmap(left.select("hash", "k1", "k2", "doc"), _noted(part_bits, met, 1))
    again = scratch.table(asked.mapInArrow(_settled_again(met, own, 1), SETTLED), "settled-again")
    for used in (met, own):
        used.destroy()
    ranges = ranges.unionByName(again.where("segment is null").select("doc", "text_key", "a", "b"))
    asked = again.where("segment is not null").select("doc", "text_key", "a", "hash", "segment")
    counts = scratch.table(asked.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("segment")).alias("size")).where("n > 1"), "hashes-to-sort")
    crowds = counts.where(F.col("n") > most_segments).select("hash")
    if not crowds.isEmpty():
        few = F.broadcast(crowds)  # each has many segments; without the hint every segment's bytes would be shuffled
        ranges = ranges.unionByName(_crowded(asked.join(few, "hash"), length, scratch))
        asked = asked.join(few, "hash", "left_anti")
    total = counts.agg(F.sum("size")).collect()[0][0] or 0
    met = bitmap(counts.select("hash"), _plain(part_bits))
    parts = asked.mapInArrow(_having(met), asked.schema).repartition(max(1, -(-total // PART_BYTES)), "hash")
    ranges = ranges.unionByName(parts.mapInArrow(_sorted_parts(length), RANGES))
    return ranges.groupBy("doc", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, ascending; those that touch become one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1]


def without(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    edge = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True))


def parted(documents: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that have nothing to remove for sure, and the others with their spans (or null) as last column."""
    names = documents.columns
    key, doc, cut = (free_name(names, x) for x in ("text_key", "doc", "spans"))
    clean, rest = split_rows(documents.withColumn(key, text_key(F.col("text"))), spans.select("text_key"))
    rest = rest.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    side = spans.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(cut))
    return clean.select(*names), rest.join(side, [doc, key], "left").select(*names, cut)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _span_arrays(spans) -> tuple[np.ndarray, np.ndarray]:
    values = spans.values
    return merged(values.field("a").to_numpy(), values.field("b").to_numpy())


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_py()
            if spans.is_valid:
                a, b = _span_arrays(spans)
                rows.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(without(data, a, b)).hexdigest()))
            else:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clean, rest = parted(narrow, removals(narrow, length))
    none = F.lit(0).cast("long")
    untouched = clean.select("doc_id", F.octet_length(utf8("text")).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(utf8("text"), 256).alias("kept_sha256"))
    return untouched.unionByName(rest.select("doc_id", utf8("text"), rest.columns[-1]).mapInArrow(_report, REPORT))


def _cut(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                if spans.is_valid and text.is_valid:
                    # a character whose bytes are only partly removed goes with them
                    texts.append(without(text.as_py().encode(), *_span_arrays(spans)).decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all their columns, with repeated strings cut out of their texts."""
    clean, rest = parted(documents, removals(documents, length))
    cut = rest.mapInArrow(_cut(documents.columns.index("text")), documents.schema)
    return clean.unionByName(cut)
