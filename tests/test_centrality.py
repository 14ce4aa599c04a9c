import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orbitmill.functions import scratch
from orbitmill.operators import centrality, graph, ranking, spaces, stats, vectors
from orbitmill.operators.graph import Graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def both_ways(pairs):
    return [p for a, b in pairs for p in ((a, b), (b, a))]


def scores(result):
    return {r["node_id"]: r["score"] for r in result.scores.collect()}


@pytest.fixture(params=["blocks", "tables"])
def strategy(request):
    return request.param


def test_complete_graph(spark, strategy):
    n = 6
    g = Graph(edges(spark, [(a, b) for a in range(n) for b in range(n) if a != b]))
    r = centrality.power_iteration(g, strategy=strategy)
    assert r.converged and r.iterations == 1
    assert r.eigenvalue == pytest.approx(n - 1)
    assert all(x == pytest.approx(1 / math.sqrt(n)) for x in scores(r).values())


def test_star_needs_the_shift(spark, strategy):
    k = 4
    g = Graph(edges(spark, both_ways([(0, i) for i in range(1, k + 1)])))
    plain = centrality.power_iteration(g, max_iter=10, strategy=strategy)
    assert not plain.converged and plain.iterations == 10
    r = centrality.power_iteration(g, shift=True, strategy=strategy)
    s = scores(r)
    assert r.converged and r.eigenvalue == pytest.approx(math.sqrt(k), abs=1e-5)
    assert s[0] == pytest.approx(1 / math.sqrt(2), abs=1e-5)
    assert s[1] == pytest.approx(1 / math.sqrt(2 * k), abs=1e-5)


def test_path_with_shift(spark):
    n = 5
    g = Graph(edges(spark, both_ways([(i, i + 1) for i in range(1, n)])))
    r = centrality.power_iteration(g, shift=True, tol=1e-9)
    expected = np.array([math.sin(i * math.pi / (n + 1)) for i in range(1, n + 1)])
    expected /= np.linalg.norm(expected)
    s = scores(r)
    assert [s[i] for i in range(1, n + 1)] == pytest.approx(expected.tolist(), abs=1e-6)
    assert r.eigenvalue == pytest.approx(2 * math.cos(math.pi / (n + 1)), abs=1e-6)


def test_directed_cycle_and_chain(spark, strategy):
    cycle = Graph(edges(spark, [(i, (i + 1) % 5) for i in range(5)]), directed=True)
    r = centrality.power_iteration(cycle, strategy=strategy)
    assert r.converged and r.eigenvalue == pytest.approx(1.0)
    chain = Graph(edges(spark, [(1, 2), (2, 3)]), directed=True)
    r = centrality.power_iteration(chain, strategy=strategy)
    assert not r.converged and r.iterations == 2
    assert sum(x * x for x in scores(r).values()) == pytest.approx(1.0)


def test_empty_graphs(spark, strategy):
    for g in (Graph(edges(spark, [])), graph.undirected(edges(spark, [(1, 1), (2, 2)]))):
        r = centrality.power_iteration(g, strategy=strategy)
        assert r.converged and r.n == 0 and r.scores.count() == 0
        assert centrality.lanczos(g, strategy=strategy).scores.count() == 0
        assert stats.graph_stats(g.edges).collect()[0].asDict() == {"n": 0, "nnz": 0, "num_edges": 0, "density": 0.0, "csr_mb": 4e-6}


def test_weights_and_directions(spark, strategy):
    rows = [(1, 2, 2.0), (2, 1, 3.0), (2, 3, 1.0), (3, 1, 4.0), (1, 3, 0.5)]
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    a = np.zeros((3, 3))
    for i, j, w in rows:
        a[i - 1, j - 1] += w
    for direction, m in (("out", a), ("in", a.T)):
        r = centrality.power_iteration(Graph(df, True, True), tol=1e-7, direction=direction, strategy=strategy)
        values, vectors = np.linalg.eig(m)
        v = np.abs(vectors[:, np.argmax(values.real)].real)
        s = scores(r)
        assert [s[i] for i in (1, 2, 3)] == pytest.approx((v / np.linalg.norm(v)).tolist(), abs=1e-6)
        assert r.eigenvalue == pytest.approx(values.real.max(), abs=1e-6)


def test_criteria():
    assert centrality.stopped("l2", 9, 1e-6, 10, 1e-6) and not centrality.stopped("l1", 1e-6, 0, 10, 1e-6)
    assert centrality.stopped("mean_l1", 1e-6, 0, 10, 1e-6) and centrality.stopped("l1_n", 9e-6, 0, 10, 1e-6)
    with pytest.raises(ValueError):
        centrality.stopped("l3", 0, 0, 1, 1)


def test_lanczos_breaks_down_on_regular_graphs(spark, strategy):
    g = Graph(edges(spark, [(a, b) for a in range(5) for b in range(5) if a != b]))
    r = centrality.lanczos(g, seed=None, strategy=strategy)
    assert r.iterations == 1 and r.converged and r.eigenvalue == pytest.approx(4.0)


def test_lanczos_agrees_with_power_iteration(spark, strategy):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2)) if a != b})
    g = graph.undirected(edges(spark, pairs))
    power = centrality.power_iteration(g, tol=1e-9)
    for again in (centrality.lanczos(g, m=8, strategy=strategy), centrality.lanczos(g, m=6, reorthogonalize=True, strategy=strategy)):
        row = ranking.compare_scores(power.scores, again.scores).collect()[0]
        assert row["n_one"] == 0 and row["max_difference"] < 1e-3


def test_rows_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(spaces, "BLOCK_EDGES", 7)
    g = Graph(edges(spark, both_ways([(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)])))
    a, b = (centrality.power_iteration(g, max_iter=4, strategy=s) for s in ("blocks", "tables"))
    assert a.iterations == b.iterations
    assert ranking.compare_scores(a.scores, b.scores).collect()[0]["max_difference"] < 1e-12


def test_many_iterations_stay_quick(spark):
    g = Graph(edges(spark, both_ways([(i, i + 1) for i in range(20)])))
    r = centrality.power_iteration(g, shift=True, tol=1e-9)
    assert r.converged and r.iterations > 100


def test_too_many_vertices_use_tables(spark, monkeypatch):
    monkeypatch.setattr(spaces, "MOST_VERTICES", 3)
    g = Graph(edges(spark, both_ways([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])))
    assert isinstance(spaces.space_of(g), spaces.TableSpace)
    with pytest.raises(ValueError):
        spaces.space_of(g, strategy="blocks")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=25), st.integers(1, 50))
def test_scores_have_norm_one_and_follow_renaming(spark, pairs, offset):
    g = graph.undirected(edges(spark, pairs))
    r = centrality.power_iteration(g, shift=True, max_iter=12)
    s = scores(r)
    if not s:
        return
    assert sum(x * x for x in s.values()) == pytest.approx(1.0)
    assert min(s.values()) >= 0
    moved = graph.undirected(edges(spark, [(a * 3 + offset, b * 3 + offset) for a, b in pairs]))
    t = scores(centrality.power_iteration(moved, shift=True, max_iter=12))
    assert [t[k * 3 + offset] for k in sorted(s)] == pytest.approx([s[k] for k in sorted(s)], abs=1e-9)


def test_ranking_ties_and_clamp(spark):
    df = spark.createDataFrame([(5, 0.5), (3, 0.5), (9, 0.7)], "node_id long, score double")
    assert [r["node_id"] for r in ranking.top_k(df, 10).orderBy("rank").collect()] == [9, 3, 5]
    assert [(r["rank"], r["node_id"]) for r in ranking.full_ranking(df).orderBy("rank").collect()] == [(1, 9), (2, 3), (3, 5)]
    assert stats.score_summary(df).collect()[0]["top_node"] == 9


def _star(spark, n=60):
    pairs = [(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, n - 1)]
    return graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))


def test_both_spaces_start_alike(spark):
    g = _star(spark)
    one, other = (centrality.lanczos(g, m=12, seed=42, reorthogonalize=True, strategy=s) for s in ("blocks", "tables"))
    assert one.alpha == pytest.approx(other.alpha) and one.beta[:-1] == pytest.approx(other.beta[:-1])
    assert ranking.compare_scores(one.scores, other.scores).collect()[0]["max_difference"] < 1e-9


def test_hot_ends_and_what_is_left_on_disk(spark, monkeypatch):
    monkeypatch.setattr(spaces, "BUCKET_EDGES", 16)
    g = _star(spark)
    folder = Path(scratch.scratch_path(spark, "x")).parent
    names = lambda: sorted(p.name for p in Path(str(folder).removeprefix("file:")).glob("*"))
    before = names()
    space = spaces.space_of(g, strategy="tables")
    assert space.hot.count() >= 59 and space.edges.count() + space.hot.count() == g.edges.count()
    x = space.uniform()
    for _ in range(4):
        x = space.step(x)[0]
    assert sum(n.startswith("iterate-") for n in names()) == 1
    space.close()
    assert names() == before
    tables, blocks = (centrality.power_iteration(g, shift=True, strategy=s) for s in ("tables", "blocks"))
    assert ranking.compare_scores(tables.scores, blocks.scores).collect()[0]["max_difference"] < 1e-9
    assert [n.split("-")[0] for n in names() if n not in before] == ["scores"]


def test_a_product_broadcasts_no_edges(spark):
    e = edges(spark, both_ways([(0, 1), (1, 2), (2, 3)]))
    y = vectors.spmv(e.distinct(), graph.vertices(e).selectExpr("node_id as id", "1.0d as x"), "out", False)
    assert "Broadcast" not in y._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, y.select("id", "y").collect())) == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 1.0)]


def test_a_basis_lies_in_files(spark, monkeypatch):
    assert spaces.MOST_VERTICES >= 60 * 20_000  # the co-purchase graph of 1 GB needs no tables
    g = _star(spark)
    expected = centrality.lanczos(g, m=12, seed=42, reorthogonalize=True)
    monkeypatch.setattr(spaces, "FILE_ENTRIES", 1)
    space = spaces.space_of(g)
    v = space.combined([(0.5, space.uniform()), (2.0, space.uniform())], keep=True)
    folder = Path(space.files.name)
    assert isinstance(v, np.memmap) and np.array_equal(v, 2.5 * space.uniform()) and len(list(folder.iterdir())) == 1
    space.close()
    assert not folder.exists()
    made = centrality.lanczos(g, m=12, seed=42, reorthogonalize=True)
    assert made.alpha == expected.alpha and made.beta == expected.beta
    assert ranking.compare_scores(made.scores, expected.scores).collect()[0]["max_difference"] == 0.0
