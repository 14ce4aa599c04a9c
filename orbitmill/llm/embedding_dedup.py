"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by ``ROUNDS`` rounds of random signs and a fast Hadamard
transform and hashed to the vertex of the cross-polytope it is nearest to: the
number and sign of its largest coordinate. Several such hashes make a key of one
table; a vector is put into the buckets of its ``PROBES`` best keys of each
table (multiprobe: the next best keys each take one second-nearest vertex).
Vectors of one label that share a bucket are candidates; their cosine is
computed in double precision and decides.

The number of hashes in a key follows from the number of vectors in the largest
label, so that buckets hold few vectors that are together by chance, and the
number of tables from that. Vectors of fewer than ``LEAST_WIDE`` components are
padded with zeros, as turns of so few dimensions would be much alike. Recall of
pairs at cosine 0.98, the least that counts, is tested for 2 to 768 components
and every number of hashes, and is over 0.9 in each case.

Equal vectors of one label are one class from the start, compared by their
components. Of buckets with the same members one is searched. Buckets travel as
pairs of numbers; vectors go only to buckets with company, in tasks of pairs of
chunks of bounded size, of which Python takes many at a time. A pair is counted
in the first bucket it shares, so numbers of links are exact over the pairs
found, without listing the pairs: what comes back is each class's number of
links and a forest that spans them.

Defined results: a null label, a vector that is null, zero, or holds null or
non-finite components links with nothing and is its own component; vectors of
different lengths are not compared; a null vec_id is never a component's id
unless all its vectors have none, and is kept only as its own component; rows
with the same vec_id are vectors of their own; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import U64, Scratch, arrow_rows, materialise, mixed

COSINE = 0.98
ROUNDS, PROBES = 3, 2
LEAST_WIDE = 64
#: Tables by the number of hashes in a key.
TABLES = {2: 8, 3: 8, 4: 8, 5: 12, 6: 16}
SEED = 11
#: Vectors of one chunk of a bucket, and of what a task handles at once.
CHUNK, BULK = 1024, 4096
#: Rows handed to Python at a time.
ROWS = 1000
#: Pairs compared at once.
PAIRS = 1 << 15
#: Buckets of up to so many vectors are compared many at a time.
SMALL = 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the length is a power of two."""
    n, d = x.shape
    h = 1
    x = x.copy()
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        total = pair[:, :, 0] + pair[:, :, 1]
        pair[:, :, 1] = pair[:, :, 0] - pair[:, :, 1]
        pair[:, :, 0] = total
        h *= 2
    return x / np.sqrt(d)


def width(d: int) -> int:
    return max(LEAST_WIDE, 1 << (d - 1).bit_length())


def hashes_of_key(n: int, d: int) -> int:
    """So many that n vectors meet few others by chance."""
    return int(np.clip(np.ceil(np.log(64.0 * max(n, 1)) / np.log(2.0 * width(d))), min(TABLES), max(TABLES)))


def bucket_keys(x: np.ndarray, joined: int, tables: int | None = None, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) keys; those of table t are t * probes and on, the best first."""
    n, d = x.shape
    wide = width(d)
    tables = tables or TABLES[joined]
    rng = np.random.default_rng([seed, wide])
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    each = np.arange(n)
    out = np.empty((n, tables, probes), U64)
    for t in range(tables):
        best, second = np.empty((joined, n), np.int64), np.empty((joined, n), np.int64)
        loss = np.empty((n, joined))
        for j in range(joined):
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            size = np.abs(y)
            one = size.argmax(axis=1)
            top = size[each, one]
            size[each, one] = -1.0
            two = size.argmax(axis=1)
            best[j], second[j] = 2 * one + (y[each, one] < 0), 2 * two + (y[each, two] < 0)
            loss[:, j] = (top - size[each, two]) ** 2
        cheapest = np.argsort(loss, axis=1, kind="stable")
        for p in range(probes):
            key = np.full(n, t + 1, U64)
            for j in range(joined):
                vertex = np.where(cheapest[:, p - 1] == j, second[j], best[j]) if p else best[j]
                key = mixed(key * U64(0x9E3779B97F4A7C15) + vertex.astype(U64))
            out[:, t, p] = key
    return out.reshape(n, tables * probes)


def _ragged(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat components and offsets of a column of lists."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _unit(flat: np.ndarray, off: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    x = flat[off[rows][:, None] + np.arange(d)].astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(most: int):
    """Buckets of vectors (rep, group, vector): those of other groups (label and length) differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = mixed(batch.column(1).to_numpy().view(U64))
            flat, off = _ragged(batch.column(2))
            size = np.diff(off)
            keys = [None] * batch.num_rows
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                for k in range(0, len(rows), 2048):
                    part = rows[k : k + 2048]
                    found = bucket_keys(_unit(flat, off, part, d), hashes_of_key(most, int(d)))
                    for r, own in zip(part, mixed(found ^ group[part][:, None]).astype(np.int64), strict=True):
                        keys[r] = np.unique(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["rep", "buckets"])

    return run


def _pairs_of(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, in bounded pieces, of groups of neighbouring rows."""
    for m in np.unique(size[size <= SMALL]):
        if m < 2:
            continue
        one, other = np.triu_indices(m, 1)
        first = start[size == m]
        step = max(1, PAIRS // len(one))
        for k in range(0, len(first), step):
            at = first[k : k + step, None]
            yield (at + one).ravel(), (at + other).ravel()
    for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = np.arange(s, s + m)
        step = max(1, PAIRS // m)
        for k in range(0, m, step):
            a, b = np.repeat(rows[k : k + step], m), np.tile(rows, len(rows[k : k + step]))
            yield a[a < b], b[a < b]


def links_of(rows: pa.Table, cosine: float) -> pa.Table | None:
    """(rep, root, n) of the links within the chunk pairs of a table: a forest, and how many of each rep's are first counted here."""
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    flat, off = _ragged(rows.column("vector"))
    d = np.diff(off)
    keys = [rows.column(c).to_numpy() for c in ("rep", "side", "ci", "cj", "bucket")]
    order = np.lexsort((keys[0], d, label, *keys[2:]))
    rep, side, ci, cj, bucket = (k[order] for k in keys)
    d, label = d[order], label[order]
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in (ci, cj, bucket, d, label):
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    copies = rows.column("copies").to_numpy()[order]
    shared, edge = _ragged(rows.column("buckets"))
    wide = int(np.diff(edge).max())
    lists = np.full((len(order), wide), -1, np.int64)
    count = np.diff(edge)[order]
    held = np.arange(wide) < count[:, None]
    lists[held] = shared[np.repeat(edge[:-1][order], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    n_links = np.zeros(len(order), np.int64)
    left, right = [], []
    for dim in np.unique(d):
        mine = d[start] == dim
        at = np.flatnonzero(d == dim)
        place = np.zeros(len(order), np.int64)
        place[at] = np.arange(len(at))
        x = _unit(flat, off, order[at], dim)
        for a, b in _pairs_of(start[mine], size[mine]):
            across = (ci[a] == cj[a]) | (side[a] != side[b])
            a, b = a[across], b[across]
            near = np.einsum("ij,ij->i", x[place[a]], x[place[b]]) >= cosine
            a, b = a[near], b[near]
            if not len(a):
                continue
            left.append(a)
            right.append(b)
            first = np.full(len(a), np.iinfo(np.int64).max)
            for c in range(wide):
                both = held[a, c] & ((lists[b] == lists[a, c][:, None]) & held[b]).any(axis=1)
                first = np.where(both, np.minimum(first, lists[a, c]), first)
            here = first == bucket[a]
            np.add.at(n_links, a[here], copies[b[here]])
            np.add.at(n_links, b[here], copies[a[here]])
    if not left:
        return None
    name, of = np.unique(rep, return_inverse=True)
    low = forest(len(name), (of[np.concatenate(left)], of[np.concatenate(right)]))
    n = np.zeros(len(name), np.int64)
    np.add.at(n, of, n_links)
    tell = (n > 0) | (low != np.arange(len(name)))
    return pa.table({"rep": pa.array(name[tell]), "root": pa.array(name[low[tell]]), "n": pa.array(n[tell])})


def _search(cosine: float):
    """Whole chunk pairs, of sorted rows, as many at a time as BULK rows hold (one at least)."""

    def ready(held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
        rows = pa.Table.from_batches(held)
        last = [rows.column(c)[rows.num_rows - 1].as_py() for c in ("bucket", "ci", "cj")]
        same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("bucket", "ci", "cj"), last, strict=True)])
        cut = int(np.flatnonzero(same)[0])
        return rows.slice(0, cut), rows.slice(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= BULK:
                whole, rest = ready(held)
                if whole.num_rows and (found := links_of(whole, cosine)) is not None:
                    yield from found.to_batches()
                held, n = rest.to_batches(), rest.num_rows
        if held and (found := links_of(pa.Table.from_batches(held), cosine)) is not None:
            yield from found.to_batches()

    return run


def _finite(vector: str) -> F.Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _links(classes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(rep, root, n) of the links found between classes."""
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    group = F.xxhash64("label", F.size("vector")).alias("group")
    hashed = scratch.table(classes.select("rep", group, "vector").mapInArrow(_hash(most), "rep long, buckets array<long>"), "vector-buckets")
    probes = hashed.select("rep", F.explode("buckets").alias("bucket"))
    member = lambda seed: F.bit_xor(F.xxhash64("rep", F.lit(seed)))
    sizes = probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), member(1).alias("m1"), member(2).alias("m2")).where("size > 1")
    # of buckets with the same members one; a table of its own, so that a hot bucket's members can be split among join tasks
    live = scratch.table(sizes.groupBy("size", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "live-buckets")
    own = probes.join(live, "bucket").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("bucket", "size"))).alias("own"))  # a vector's probes at most
    own = scratch.table(own, "own-buckets")
    chunks = F.ceil(F.col("one.size") / F.lit(CHUNK)).cast("int")
    chunked = (
        classes.join(own, "rep")
        .select("rep", "label", "vector", "copies", F.transform("own", lambda o: o["bucket"]).alias("buckets"), F.explode("own").alias("one"))
        .select("rep", "label", "vector", "copies", "buckets", F.col("one.bucket").alias("bucket"), chunks.alias("chunks"))
        .withColumn("side", F.pmod(F.xxhash64(F.lit("chunk"), "rep"), F.col("chunks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("rep", "label", "vector", "copies", "buckets", "bucket", "side", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"))
    )
    dealt = chunked.repartition("bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj")
    return scratch.table(dealt.mapInArrow(_search(cosine), "rep long, root long, n long"), "vector-links")


def embedding_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    plain = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if plain else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & _finite("vector"))
    # -0.0 and 0.0 are one number
    same = F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))
    usable = rows.where("usable").select("vec_id", "label", same.alias("vector"))
    with arrow_rows(spark, ROWS), Scratch(spark) as scratch:
        equal = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        # numbered once, in a table
        classes = scratch.table(equal.withColumn("rep", F.monotonically_increasing_id()), "vectors")
        found = _links(classes, cosine, scratch)
        joined = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")), scratch, "vectors")
        counts = found.groupBy("rep").agg(F.sum("n").alias("n")).select(F.col("rep").alias("r"), "n")
        group = (
            classes.join(joined, F.col("rep") == F.col("node"), "left")
            .join(counts, F.col("rep") == F.col("r"), "left")
            .select("label", "vector", "least", F.coalesce("component", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        )
        group = scratch.table(group, "vector-groups")
        least = scratch.table(group.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
        named = materialise(group.join(least, "root").select("label", "vector", "n_links", "component_id"), "vector-components")
    linked = usable.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce("usable", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
