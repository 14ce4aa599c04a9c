import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitmill.functions.scratch import Scratch
from orbitmill.llm import mixing as m

from .conftest import TEXTS, as_set


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, most=3):
    """Targets by sharing again until none is above its limit."""
    target, stopped = [0.0] * len(sizes), set()
    left = float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        share = left / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if share * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = share * weights[i]
            return target
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            stopped.add(i)


def many(make_documents, spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3000):
        source = "hot" if k % 3 else f"s{int(rng.integers(0, 6))}"
        rows.append((k, source if k % 50 else None, "w " * int(rng.lognormal(3, 1))))
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


def test_targets_and_takes(make_documents, spark):
    docs, rows = many(make_documents, spark)
    out = m.mix(docs, block=64).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    size = {i: n_words(t) for i, _, t in rows}
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    total = [sum(size[i] for i, s, _ in rows if s == name) for name in names]
    target = fill(total, [1 + k % 3 for k in range(len(names))])
    for name, whole, aim in zip(names, total, target, strict=True):
        mine = [r for r in out if r["source"] == name]
        assert {r["source_size"] for r in mine} == {whole}
        assert mine[0]["target"] == pytest.approx(aim)
        assert abs(sum(r["taken"] for r in mine) - aim) <= 20
        assert abs(sum(r["copies"] for r in mine) - len(mine) * aim / whole) <= 3
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in out)
    again = m.mix(docs.repartition(7), block=64)
    assert as_set(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in out), key=repr)


def test_rows_without_ids_are_spread(spark):
    n = 100_000
    docs = spark.range(n).selectExpr("cast(null as long) as doc_id", "if(id % 10 = 0, 'small', 'hot') as source", "'one two three' as text")
    with Scratch(spark) as scratch:
        dealt = m.numbered(docs.selectExpr("source", "doc_id", "cast(3 as long) as size"), scratch)
        assert dealt.count() == n and dealt.distinct().count() == n
        block = F.pmod(F.xxhash64("doc_id", "size", "number", F.lit(m.SEED)), F.lit(n // m.BLOCK))
        most = dealt.groupBy("source", block).count().agg(F.max("count")).collect()[0][0]
    assert most < 2 * m.BLOCK
    out = m.mix(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("copies"))
    rows = {r["source"]: r for r in out.collect()}
    assert rows["hot"]["n"] == 90_000 and rows["small"]["n"] == 10_000 and rows["small"]["copies"] == 3
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in rows.values())


def test_takes_equal_a_plain_flight(spark):
    """One block a source: the mix takes what a flight and landing written out here takes."""
    rng = np.random.default_rng(12)
    rows = [(i, f"s{i % 3}", int(x)) for i, x in enumerate(rng.integers(1, 60, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size int").selectExpr("doc_id", "source", "repeat('w ', size) as text")
    got = {r["doc_id"]: r["taken"] for r in m.mix(docs).collect()}
    sizes = [sum(x for _, s, x in rows if s == f"s{k}") for k in range(3)]
    for k, aim in enumerate(fill(sizes, [1, 2, 3])):
        mine = [(i, x) for i, s, x in rows if s == f"s{k}"]
        times = aim / sizes[k]
        size = np.array([x for _, x in mine])
        drawn = m.land(np.full(len(mine), times - int(times)), size, np.random.default_rng([m.SEED, 0, 0, int.from_bytes(f"s{k}".encode(), "big")]))
        assert [got[i] for i, _ in mine] == [x * (int(times) + int(c)) for (_, x), c in zip(mine, drawn, strict=True)]


def test_odd_rows(documents):
    out = m.mix(documents).collect()
    assert len(out) == len(TEXTS)
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=repr) == sorted(((i, n_words(t)) for i, t in TEXTS), key=repr)
    assert all(r["taken"] <= 3 * r["size"] for r in out)


def test_empty_and_wordless_tables(no_documents, make_documents):
    assert m.mix(no_documents).count() == 0
    out = m.mix(make_documents([(1, ""), (2, None)])).collect()
    assert [(r["target"], r["taken"]) for r in out] == [(0.0, 0), (0.0, 0)]


def test_water_filling(spark):
    for sizes in ([10], [100, 1, 1], [5, 5, 5, 5], [1, 1000, 3, 7, 0], [0, 0]):
        rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
        got = {r["source"]: r["target"] for r in m.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(fill(sizes, [1 + i % 3 for i in range(len(sizes))]) if sum(sizes) else sizes)


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 40).astype(float)
    chance = rng.uniform(0.05, 0.95, 40)
    seen = np.zeros(40)
    for k in range(600):
        p = m.fly(chance, size, np.random.default_rng(k))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(chance.sum()) and p @ size == pytest.approx(chance @ size)
        seen += p
    assert np.abs(seen / 600 - chance).max() < 0.1
    done = m.land(chance, size, rng)
    assert set(done.tolist()) <= {0.0, 1.0} and abs(done @ size - chance @ size) < 10


def long_tailed(rng, n):
    return np.minimum(rng.lognormal(5, 1.5, n).astype(int), 20_000)


def test_small_sources_beside_a_large_one(spark):
    rng = np.random.default_rng(3)
    number = {"hot": 700, **{f"s{k:02d}": 100 for k in range(20)}}
    rows = [(source, int(x)) for source, n in number.items() for x in long_tailed(rng, n)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, size int").selectExpr("doc_id", "source", "repeat('w ', size) as text")
    miss = {}
    for r in m.mix(docs).collect():
        miss[r["source"]] = miss.get(r["source"], -r["target"]) + r["taken"]
    assert len(miss) == 21 and max(map(abs, miss.values())) <= 100


def test_blocks_keep_units_of_falling_sizes_back():
    rng = np.random.default_rng(4)
    for blocks in (2, 5, 30):
        sizes = [long_tailed(rng, 500) for _ in range(blocks)]
        flown = [m.pass_on(np.full(500, 0.4), x, rng, k, blocks) for k, x in enumerate(sizes)]
        chance, size = np.concatenate(flown), np.concatenate(sizes)
        assert chance.sum() == pytest.approx(200 * blocks) and chance @ size == pytest.approx(0.4 * size.sum())
        left = (chance > 0) & (chance < 1)
        assert m.LANDING <= left.sum() <= max(m.LANDING, blocks) + 2 * blocks
        assert abs(m.land(chance, size, rng) @ size - 0.4 * size.sum()) <= 100
