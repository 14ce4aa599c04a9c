import math

import numpy as np
import pytest

from orbitmill.llm import embedding_dedup as e

from .conftest import as_set

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, key string, n string, copies string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", "x", "x", "x") for i, v, y in rows], SCHEMA)


def brute(rows, cosine=0.98):
    ok = [y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, y in rows]
    n = len(rows)
    low, count = list(range(n)), [0] * n

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    count[i] += 1
                    count[j] += 1
                    low[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted([(rows[i][0], count[i], least.get(root(i)), rows[i][0] == least.get(root(i))) for i in range(n)], key=repr)


def near(rng, base, spread, k):
    return [base + rng.normal(0, spread, len(base)) for _ in range(k)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(0, 1, 24)
            rows += [(len(rows) + k, v, label) for k, v in enumerate(near(rng, base, 0.09, int(rng.integers(1, 6))))]
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)] + [(1010, [-x for x in rows[0][1]], 0), (1011, [2 * x for x in rows[0][1]], 0)]
    got = as_set(e.embedding_components(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    want = brute(rows)
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0


def test_hot_group_in_small_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("BULK", 40), ("SMALL", 9), ("PAIRS", 64), ("ROWS", 7)):
        monkeypatch.setattr(e, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 32)
    rows = [(k, v, 4) for k, v in enumerate(near(rng, base, 0.08, 150))]
    assert as_set(e.embedding_components(table(spark, rows)), "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, None), (2, None, 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [float("nan"), 2.0, 3.0], 1), (6, [float("inf"), 2.0, 3.0], 1), (7, [], 1),
        (8, v, 1), (9, v, 1), (9, v, 1), (None, v, 1), (10, [1.0, 2.0], 1), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2), (None, [5.0], 3), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1),
    ]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in e.embedding_components(table(spark, rows)).collect()}
    assert {(i, 0, i) for i in range(1, 8)} <= got
    assert {(8, 5, 8), (9, 5, 8), (None, 5, 8), (13, 5, 8), (14, 5, 8), (10, 0, 10), (11, 1, 11), (12, 1, 11), (None, 0, None)} <= got


def test_empty_table(spark):
    assert e.embedding_components(table(spark, []).limit(0)).count() == 0


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(e.hadamard(x) @ e.hadamard(x).T, np.eye(8))


@pytest.mark.parametrize("d", [2, 3, 4, 8, 64, 100, 384, 768])
def test_recall_at_the_least_cosine(d):
    n = 800 if d <= 100 else 200
    rng = np.random.default_rng(d)
    a = rng.normal(0, 1, (n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(0, 1, a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * noise
    for joined in e.TABLES:
        ka, kb = e.bucket_keys(a, joined), e.bucket_keys(b, joined)
        assert (ka[:, :, None] == kb[:, None, :]).any(axis=(1, 2)).mean() >= 0.93
        assert np.mean([len(np.unique(k)) for k in ka]) == pytest.approx(e.TABLES[joined] * e.PROBES)


def test_few_meet_by_chance():
    rng = np.random.default_rng(6)
    together = []
    for n in (500, 4000):
        x = rng.normal(0, 1, (n, 64))
        keys = e.bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), e.hashes_of_key(n, 64))
        _, count = np.unique(keys, return_counts=True)
        together.append((count * (count - 1)).sum() / n)
    assert max(together) < 1
