"""Mixing sources to target weights by the cube method.

A document's size is its number of words. Each source has a target number of
words; a document is expected ``target / source size`` times in the mix, of
which the whole part is certain and the fraction is its inclusion probability.
The cube method decides the fractions: it moves the vector of probabilities
along directions of the constraint matrix's null space, which keeps the
expected number of documents and of words, until every unit but a few is at 0
or 1 (flight). The last ones and some units of falling sizes kept back for them
are a landing problem of at most ``LANDING`` + 2 units, solved by comparing all
outcomes.

Flights run in blocks of about ``BLOCK`` documents of one source, dealt by a
hash of the document and, of documents equal in source, doc_id and size, their
number among these, so no source and no repeated or missing id is gathered in
one task. At most two
documents of a block stay undecided; these and the units it keeps back (the
blocks of a source take turns among ``LANDING`` sizes, one at least each) meet
in blocks of the next level. A source lands at the level where it has one block
left, whatever other sources still have. Its taken words thus miss its target by
a few words only, where it has units enough. Random steps come from the seed and
the block's number: reruns agree whatever the partitioning.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 may be taken and add nothing; sources whose
sizes are all 0 have target 0; rows are decided singly even where doc_ids are
null or repeated (of equal rows it is undefined which one is taken, and they
are equal); an empty table gives no rows. Other columns are not read. Targets
are shared in one task over the table of sources, a row of four numbers each, so
there may be some millions of sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialise

BLOCK = 512
SEED = 20_240_229
#: A source's target is at most so many times its size.
MOST_TIMES = 3
#: Weights of sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Units of a source kept back for its landing.
LANDING = 12
#: Their sizes fall by this at most from one to the next; under 2, so that sums of some of them leave no gaps.
RATIO = 1.8
#: Equal documents are numbered in runs of so many.
RUN = 4096
_TINY = 1e-9

UNIT = "source string, doc_id long, size long, whole int, chance double, block long, blocks long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: number of documents, source_size, target.

    Targets share all words by weight; where that passes ``most`` times the
    source's size, the target stops there and the rest is shared again. Sorted
    by (limit / weight) the stopped sources come first, so the common factor of
    the others follows from running sums over the table of sources.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = by_source.select("*", weight.alias("weight")).withColumn("limit_", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    factor = left_words / left_weight
    open_ = weighed.withColumn("factor", F.when(factor * F.col("weight") <= F.col("limit_"), factor))
    first = F.first("factor", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shared = open_.withColumn("common", first)
    return shared.select("source", "n_docs", "source_size", F.least(F.col("limit_"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit_"))).alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities, in order, until at most two are strictly between 0 and 1."""
    p = chance.tolist()
    x = [float(s) for s in size]
    todo = [i for i, v in enumerate(p) if _TINY < v < 1 - _TINY]
    todo.reverse()
    coins = rng.random(2 * len(todo) + 8).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = active
            u = [x[c] - x[b], x[a] - x[c], x[b] - x[a]]
            if u[0] == u[1] == u[2] == 0:
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and x[active[0]] == x[active[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(active, u, strict=True) if v)
        step = up if coins.pop() * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q <= _TINY else 1.0 if q >= 1 - _TINY else q
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array([0.0 if v <= _TINY else 1.0 if v >= 1 - _TINY else v for v in p])


def spread(chance: np.ndarray, size: np.ndarray, places: range = range(LANDING)) -> np.ndarray:
    """Undecided units at these of ``LANDING`` places, from the largest down in steps of one ratio."""
    open_ = np.flatnonzero((chance > _TINY) & (chance < 1 - _TINY))
    ranked = open_[np.argsort(size[open_], kind="stable")]
    if not len(ranked):
        return ranked
    scale, place = np.log(1.0 + size[ranked]), np.arange(LANDING)
    step = min((scale[-1] - scale[0]) / (LANDING - 1), np.log(RATIO))
    at = np.searchsorted(scale, scale[-1] - step * place[::-1] - _TINY)
    # units of their own
    at = np.minimum(np.maximum.accumulate(at - place) + place, len(ranked) - LANDING + place)[list(places)]
    return ranked[at[at >= 0]]


def pass_on(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator, block: int, blocks: int) -> np.ndarray:
    """Flies a block of a source that has several, but for the units it keeps back for the landing."""
    kept = spread(chance, size, range(block % LANDING, LANDING, blocks))
    flying = np.setdiff1d(np.arange(len(chance)), kept)
    out = chance.copy()
    out[flying] = fly(chance[flying], size[flying], rng)
    return out


def land(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flies all units but ``LANDING`` of falling sizes, then decides these and what the flight left.

    All outcomes of the last units are compared; the one nearest to the
    expected words, then documents, is taken.
    """
    chance = np.where(chance <= _TINY, 0.0, np.where(chance >= 1 - _TINY, 1.0, chance))
    flying = np.setdiff1d(np.arange(len(chance)), spread(chance, size))
    out = chance.copy()
    out[flying] = fly(chance[flying], size[flying], rng)
    left = np.flatnonzero((out > 0) & (out < 1))
    if len(left):
        choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs((choice - out[left]) @ size[left].astype(float))
        docs = np.abs((choice - out[left]).sum(axis=1))
        cost = words + 0.1 * (1 + size[left].mean()) * docs
        out[left] = choice[int(np.argmin(cost))]
    return out


def _flight(seed: int, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        doc = rows.column("doc_id").to_numpy(zero_copy_only=False)
        size = rows.column("size").to_numpy()
        chance = rows.column("chance").to_numpy()
        known = np.nan_to_num(doc.astype(float), nan=-1.0) if doc.dtype != np.int64 else doc
        order = np.lexsort((chance, size, known))
        source, block, blocks = (k.as_py() for k in key)
        name = int.from_bytes(("\x00" if source is None else source).encode("utf-8", "surrogatepass"), "big")
        rng = np.random.default_rng([seed, level, block, name])
        moved = np.empty(len(chance))
        moved[order] = land(chance[order], size[order], rng) if blocks == 1 else pass_on(chance[order], size[order], rng, block, blocks)
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(moved))

    return run


def numbered(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """source, doc_id, size and the number of each row among those equal in all three."""
    equal = scratch.table(sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-equal")
    few = equal.where(F.col("n") <= RUN).withColumn("run", F.lit(0).cast("long"))
    # many equal rows are counted out in runs, each where it is dealt to
    runs = equal.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(RUN)))))
    every = few.unionByName(runs.repartition("source", "doc_id", "size", "run"))
    first = F.col("run") * F.lit(RUN)
    return every.select("source", "doc_id", "size", F.explode(F.sequence(first, F.least(first + F.lit(RUN), F.col("n")) - 1)).alias("number"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies and source of every document."""
    with Scratch(documents.sparkSession) as scratch:
        sizes = documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"))
        sizes = scratch.table(numbered(sizes, scratch), "mix-sizes")
        plan = targets(sizes, weights, most).withColumn("blocks", F.ceil(F.col("n_docs") / F.lit(block)).cast("long"))
        side = materialise(plan.select(F.col("source").alias("s"), "target", "source_size", "blocks"), "mix-targets")
        times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
        dealt = F.pmod(F.xxhash64("doc_id", "size", "number", F.lit(seed)), F.col("blocks"))
        units = (
            sizes.join(side, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("times", times)
            .select("source", "doc_id", "size", F.floor("times").cast("int").alias("whole"), (F.col("times") - F.floor("times")).alias("chance"), dealt.alias("block"), "blocks")
        )
        sure = F.col("chance").isin(0.0, 1.0)
        wide = side.agg(F.max("blocks")).collect()[0][0] or 1
        level, decided, todo = 0, [], units
        while True:
            last = wide == 1
            flown = materialise(todo.groupBy("source", "block", "blocks").applyInArrow(_flight(seed, level), UNIT), f"mix-flight-{level}")
            decided.append(flown.where(sure))
            if last:
                break
            per = block // 2
            wide = -(-wide // per)
            todo = flown.where(~sure).withColumn("block", F.floor(F.col("block") / F.lit(per)).cast("long")).withColumn("blocks", F.ceil(F.col("blocks") / F.lit(per)).cast("long"))
            level += 1
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    every = every.drop("blocks")
    copies = (F.col("whole") + F.col("chance").cast("int")).cast("int")
    return every.join(side, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "source"
    )
