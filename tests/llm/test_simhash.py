import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as p
from orbitmill.llm import components as c
from orbitmill.llm import simhash as s

from orbitmill.functions.scratch import Scratch

from .conftest import TEXTS, as_set


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(prints, ids, distance=2):
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                low[root(i)] = root(j)
    groups = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            groups[root(i)] = min(groups.get(root(i), doc), doc)
    return [groups.get(root(i)) for i in range(len(prints))]


def test_equals_brute_force(documents):
    prints = [fingerprint(t) for _, t in TEXTS]
    expected = [(i, f"{f:016x}", k) for (i, _), f, k in zip(TEXTS, prints, brute(prints, [i for i, _ in TEXTS]), strict=True)]
    got = as_set(s.simhash_components(documents), "doc_id", "fingerprint", "component_id")
    assert got == sorted(expected, key=repr)


def test_links_within_two_bits(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(12)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    classes = spark.createDataFrame([(p, p) for p in prints], "fp long, rep long")
    for chunk in (4, 1024):
        c.CHUNK, old = chunk, c.CHUNK
        try:
            with Scratch(spark) as scratch:
                links = s.close_links(classes, scratch)
                dealt = c.chunk_pairs(classes.selectExpr("fp", "rep", "fp & 4294967295 as part"), ["part"], "fp", scratch)
                assert dealt.where("ci < cj").isEmpty() == (chunk > 100)
                linked = {r["node"]: r["component"] for r in c.components(links, scratch).collect()}
        finally:
            c.CHUNK = old
        got = [linked.get(p, p) for p in prints]
        unsigned = [p % (1 << 64) for p in prints]
        expected = brute(unsigned, prints)
        assert got == expected


def test_one_of_each_group_stays(spark, documents, make_documents):
    kept = s.keep_each(documents)
    assert kept.schema == documents.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 6 in ids and 7 not in ids and None in ids and 12 in ids
    plain = make_documents([(1, "one two three four"), (2, "one two three four"), (3, "something else entirely here")])
    for name in ("__text", "__key", "__KEY_"):
        plain = plain.withColumn(name, F.lit("kept"))
    assert as_set(s.keep_each(plain), "doc_id", "__text", "__key") == [(1, "kept", "kept"), (3, "kept", "kept")]


def test_the_row_that_stays_is_always_the_same(make_documents):
    docs = make_documents([(1, "one two three four")] * 20 + [(2, "one two three four")]).withColumn("lang", F.monotonically_increasing_id().cast("string"))
    first = {tuple(r) for r in s.keep_each(docs.repartition(5, "lang")).collect()}
    assert len(first) == 1 and first == {tuple(r) for r in s.keep_each(docs.repartition(2, "lang")).collect()}


def test_groups_of_shared_and_missing_ids(spark, documents, make_documents):
    found = p.near_duplicates(spark, documents, "")
    assert found.schema == documents.schema
    texts = [(r["doc_id"], r["text"]) for r in found.collect()]
    prints = [fingerprint(t) for _, t in TEXTS]
    groups = brute(prints, range(len(TEXTS)))
    group_of = {fp: g for fp, g in zip(prints, groups, strict=True)}
    assert sorted(group_of[fingerprint(t)] for _, t in texts) == sorted(set(groups))
    assert (15, "the same id, another text") in texts and (15, TEXTS[16][1]) in texts
    odd = [(None, "one two three four"), (None, "one two three four"), (None, "five six seven eight"), (7, "five six seven eight"), (None, None), (None, ""), (7, "nine ten eleven twelve"), (9, "nine ten eleven twelve")]
    kept = [(r["doc_id"], r["text"] or "") for r in s.keep_each(make_documents(odd).repartition(3)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, "one two three four"), (7, "five six seven eight"), (None, ""), (7, "nine ten eleven twelve")], key=repr)


def test_empty_table(no_documents):
    assert s.simhash_components(no_documents).count() == 0
    assert s.keep_each(no_documents).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    with Scratch(spark) as scratch:
        got = {r["component"] for r in c.components(chain, scratch).collect()}
        assert got == {0}
        assert c.components(chain.limit(0), scratch).count() == 0


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        low = c.forest(n, (a, b))
        want = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b, strict=True):
                want[i] = want[j] = min(want[i], want[j])
        assert low.tolist() == want


def test_block_keys_cover_all_pairs():
    masks = s.block_keys(4, 2)
    assert len(masks) == 6
    for i in range(64):
        for j in range(i):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)
