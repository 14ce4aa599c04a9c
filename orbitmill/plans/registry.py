"""All registered queries of the graph engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp_noise
from ..functions.scratch import materialise, scratch_path
from ..operators import centrality, graph, ranking, stats, vectors
from ..operators.graph import Graph
from ..sources import artifacts, csr_binary, edge_text
from . import fixtures as fx
from . import sql

Query = Callable[[SparkSession, str], DataFrame]

SCORE = "SELECT id AS node_id, round(x, 6) AS score, k::BIGINT AS iterations FROM last"


def _scores(result: centrality.Result, digits: int = 6) -> DataFrame:
    return result.scores.select("node_id", F.round("score", digits).alias("score"), F.lit(result.iterations).cast("long").alias("iterations"))


def _edges(e: DataFrame) -> DataFrame:
    return e.select("src", "dst")


def _copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a table, for queries that read it several times."""
    return materialise(fx.copurchase(spark, sf_dir), "copurchase")


def _degree_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(fx.copurchase(spark, sf_dir)).select(F.col("node_id").alias("id"), F.col("degree").cast("double").alias("x"))


DEGREES = f"SELECT src AS id, count(*)::DOUBLE AS x FROM ({fx.COPURCHASE}) GROUP BY 1"


def edge_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_text.parse_edges(fx.dirty_lines(spark, sf_dir))


def self_loop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_loops(fx.trade(spark, sf_dir))


def symmetrize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(graph.undirected(fx.handoff(spark, sf_dir)).edges)


def vertex_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(graph.without_loops(fx.handoff(spark, sf_dir)))


def unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_columns(_edges(fx.trade(spark, sf_dir)))


def weight_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unweighted(Graph(fx.trade(spark, sf_dir), True, True)).edges


def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(fx.copurchase(spark, sf_dir))


def compact_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertex_index(fx.copurchase(spark, sf_dir))


INDEX = "SELECT id AS node_id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx FROM (SELECT DISTINCT src AS id FROM e)"


def encode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    return graph.encoded(_edges(e), graph.vertex_index(e))


def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    index = graph.vertex_index(e)
    coded = graph.encoded(_edges(e), index).groupBy(F.col("src_idx").alias("idx")).agg(F.sum("dst_idx").alias("total"))
    return graph.decoded(coded, index).select("node_id", "total")


def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.adjacency(fx.copurchase(spark, sf_dir))
    return rows.select("src", F.array_join("neighbors", ",").alias("neighbors"), graph.row_degree(F.col("neighbors")).alias("degree"))


def csr_row_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.csr_rows(fx.copurchase(spark, sf_dir))


def csr_col_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    return graph.csr_columns(e, graph.vertex_index(e)).select("pos", "col_idx")


def csr_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    return graph.csr_to_edges(graph.csr_rows(e), graph.csr_columns(e, graph.vertex_index(e)))


def csr_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    return graph.csr_checks(graph.csr_rows(e), graph.csr_columns(e, graph.vertex_index(e)))


def graph_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_type(graph.without_loops(fx.handoff(spark, sf_dir)))


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.without_loops(fx.handoff(spark, sf_dir)))


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degree_stats(fx.copurchase(spark, sf_dir)).withColumn("avg_degree", F.round("avg_degree", 6))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.graph_stats(fx.copurchase(spark, sf_dir))
    return out.withColumn("density", F.round("density", 9)).withColumn("csr_mb", F.round("csr_mb", 6))


def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree_vector(spark, sf_dir).agg(F.round(vectors.norm_of(F.col("x")), 6).alias("norm"))


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _degree_vector(spark, sf_dir)
    return vectors.dot(v, v.select("id", F.col("id").cast("double").alias("x"))).select(F.round("dot", 3).alias("dot"))


def vector_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _degree_vector(spark, sf_dir)
    out = vectors.combined([(1.0, v), (-0.5, v.select("id", F.col("id").cast("double").alias("x")))])
    return out.select("id", F.round("x", 6).alias("x"))


def _two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(fx.copurchase(spark, sf_dir))
    one, two = (centrality.power_iteration(g, max_iter=k, tol=0.0).scores.select(F.col("node_id").alias("id"), F.col("score").alias("x")) for k in (1, 2))
    return vectors.residuals(two, one)


def _residual(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _two_steps(spark, sf_dir).select(F.round(name, 9).alias(name))

    return run


RESIDUAL = {
    "l1": "SELECT round(max(l1), 9) AS l1 FROM last",
    "l2": "SELECT round(max(l2), 9) AS l2 FROM last",
    "mean_l1": "SELECT round(max(l1) / (SELECT n FROM n), 9) AS mean_l1 FROM last",
    "max_abs": "SELECT round(max(abs(a.x - b.x)), 9) AS max_abs FROM it a JOIN it b ON a.id = b.id WHERE a.k = 2 AND b.k = 1",
}


def _product(edges: Callable, direction: str, weighted: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = materialise(edges(spark, sf_dir), "edges")
        x = graph.vertices(e).select(F.col("node_id").alias("id"), (F.lit(1.0) / (F.col("node_id") + 1)).alias("x"))
        return vectors.spmv(e, x, direction, weighted).select("id", F.round("y", 6).alias("y"))

    return run


def _product_sql(edges: str, direction: str, weighted: bool) -> str:
    row, col = ("src", "dst") if direction == "out" else ("dst", "src")
    w = "w" if weighted else "1.0"
    return (
        f"WITH e AS ({edges}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT v.id, round(coalesce(sum({w} * (1.0::DOUBLE / (e.{col} + 1))), 0.0), 6) AS y "
        f"FROM v LEFT JOIN e ON e.{row} = v.id GROUP BY v.id"
    )


def _power(edges: Callable, make: Callable[[DataFrame], Graph], **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scores(centrality.power_iteration(make(edges(spark, sf_dir)), **options))

    return run


def _plain(e: DataFrame) -> Graph:
    return Graph(e)


def power_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver that keeps vectors as tables, for graphs of any size."""
    return _scores(centrality.power_iteration(_plain(fx.copurchase(spark, sf_dir)), strategy="tables"))


def evc_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(centrality.reference_centrality(graph.directed(fx.handoff(spark, sf_dir))))


def evc_bipartite_nonconvergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = centrality.power_iteration(_plain(fx.customer_supplier(spark, sf_dir)), max_iter=20)
    return spark.range(1).select(F.lit(r.n).cast("long").alias("n"), F.lit(r.iterations).cast("long").alias("iterations"), F.lit(r.converged).alias("converged"), F.round(F.lit(r.residual), 6).alias("residual"))


def lanczos_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = centrality.lanczos(_plain(fx.copurchase(spark, sf_dir)), m=6, seed=None)
    rows = [(j + 1, round(a, 5), round(b, 5)) for j, (a, b) in enumerate(zip(r.alpha, r.beta, strict=True))]
    return spark.createDataFrame(rows, "j long, alpha double, beta double")


def lanczos_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = centrality.lanczos(_plain(fx.copurchase(spark, sf_dir)), m=10, seed=None)
    return r.scores.select("node_id", F.round("score", 5).alias("score"))


def dominant_eigenvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = centrality.power_iteration(_plain(fx.copurchase(spark, sf_dir)), max_iter=30, tol=0.0)
    return spark.range(1).select(F.round(F.lit(r.eigenvalue), 6).alias("eigenvalue"))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.power_iteration(_plain(fx.copurchase(spark, sf_dir))).scores


def score_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_summary(_final(spark, sf_dir)).select(F.round("score_sum", 5).alias("score_sum"))


def top_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_summary(_final(spark, sf_dir)).select("top_node", F.round("top_score", 6).alias("top_score"))


def top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_final(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.full_ranking(_final(spark, sf_dir)).withColumn("score", F.round("score", 6))


RANKED = "SELECT row_number() OVER (ORDER BY x DESC, id)::BIGINT AS rank, id AS node_id, round(x, 6) AS score FROM last"


def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power iteration against Lanczos' method: do they rate the same vertices alike?"""
    g = _plain(_copurchase(spark, sf_dir))
    out = ranking.compare_scores(centrality.power_iteration(g, tol=1e-10).scores, centrality.lanczos(g, m=10, seed=None).scores)
    return out.select("n_both", "n_one", (F.col("max_difference") < 1e-6).alias("alike"))


def sign_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = graph.vertices(fx.copurchase(spark, sf_dir))
    i = F.col("node_id")
    x = F.when(i % 3 == 0, F.lit(5e-7)).when(i % 3 == 1, -i.cast("double")).otherwise(i / 2)
    signed = vectors.signed_by_largest(v.select(i.alias("id"), x.alias("x")))
    return signed.select("id", F.round(clamp_noise(F.col("x")), 8).alias("x"))


SIGN_CLAMP = f"""
WITH e AS ({fx.COPURCHASE}), v AS (SELECT DISTINCT src AS id FROM e),
s AS (SELECT id, CASE id % 3 WHEN 0 THEN 5e-7 WHEN 1 THEN -id::DOUBLE ELSE id / 2.0::DOUBLE END AS x FROM v),
f AS (SELECT CASE WHEN arg_max(x, abs(x)) < 0 THEN -1.0 ELSE 1.0 END AS f FROM s),
t AS (SELECT id, x * f AS x FROM s, f)
SELECT id, round(CASE WHEN x < 0 AND x > -1e-6 THEN 0.0 ELSE x END, 8) AS x FROM t
"""


def csr_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _copurchase(spark, sf_dir)
    rows = materialise(graph.csr_rows(e), "csr-rows")
    index = rows.select("node_id", "idx")
    folder = scratch_path(spark, "csr")
    store, name = csr_binary.open_store(folder)
    store.create_dir(name)
    csr_binary.write_csr(rows, graph.csr_columns(e, index), f"{folder}/graph.csr")
    read = csr_binary.read_csr(spark, f"{folder}/graph.csr")
    back = index.select(F.col("idx").alias("src"), F.col("node_id").alias("a"))
    to = index.select(F.col("idx").alias("dst"), F.col("node_id").alias("b"))
    return read.join(back, "src").join(to, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def csr_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "arrays")
    _write_arrays(_copurchase(spark, sf_dir), folder)
    back = artifacts.csr_from_arrays(artifacts.read_array(spark, f"{folder}/indptr"), artifacts.read_array(spark, f"{folder}/indices"))
    return graph.csr_to_edges(*back)


def csv_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top nodes and metrics, written and read again."""
    e = fx.copurchase(spark, sf_dir)
    result = centrality.power_iteration(_plain(e))
    out = artifacts.OutputPaths.of(scratch_path(spark, "run"), "copurchase")
    artifacts.write_scores(result.scores, out.scores)
    artifacts.write_top(result.scores, out.top)
    artifacts.write_metrics(artifacts.metrics_row(spark, result, "copurchase", e, "power", 1000, 1e-6), out.metrics)
    top = artifacts.read_csv(spark, out.top, artifacts.TOP)
    scores = artifacts.read_csv(spark, out.scores, artifacts.SCORES)
    metrics = artifacts.read_json(spark, out.metrics, artifacts.METRICS).select("num_nodes", "nnz", "iterations", "converged", "top_node")
    return top.join(scores.select("node_id", F.col("score").alias("again")), "node_id").join(F.broadcast(metrics), F.lit(True)).select(
        "rank", "node_id", F.round("score", 6).alias("score"), (F.col("score") == F.col("again")).alias("same"), "num_nodes", "nnz", "iterations", "converged", "top_node"
    )


def _folder(spark: SparkSession, tag: str) -> str:
    folder = scratch_path(spark, tag)
    store, name = csr_binary.open_store(folder)
    store.create_dir(name)
    return folder


def csr_binary_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary file without weights, by the vertices' indices."""
    e = _copurchase(spark, sf_dir)
    path = f"{_folder(spark, 'csr')}/graph.csr"
    csr_binary.write_csr(graph.csr_rows(e), graph.csr_columns(e, graph.vertex_index(e)), path, weighted=False)
    return csr_binary.read_csr(spark, path, weighted=False).select(F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx"), "w")


def _write_arrays(e: DataFrame, folder: str) -> None:
    rows = materialise(graph.csr_rows(e), "csr-rows")
    columns = materialise(graph.csr_columns(e, rows.select("node_id", "idx")), "columns")
    end = rows.agg(F.count(F.lit(1)).alias("pos"), F.sum("degree").alias("value"))
    artifacts.write_array(rows.select(F.col("idx").alias("pos"), F.col("row_start").alias("value")).unionByName(end), f"{folder}/indptr")
    artifacts.write_array(columns.select("pos", F.col("col_idx").alias("value")), f"{folder}/indices")
    artifacts.write_array(columns.select("pos", F.col("w").alias("value")), f"{folder}/data")


def csr_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSR arrays as text, checked, packed into a binary file and read."""
    folder = _folder(spark, "pack")
    _write_arrays(graph.directed(fx.trade(spark, sf_dir), "w").edges, folder)
    artifacts.pack(spark, f"{folder}/indptr", f"{folder}/indices", f"{folder}/graph.csr", f"{folder}/data")
    return csr_binary.read_csr(spark, f"{folder}/graph.csr").select(F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx"), "w")


def convert_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted, directed edge list as text, converted to a binary file and read."""
    from .. import cli

    folder = _folder(spark, "convert")
    lines = fx.trade(spark, sf_dir).select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string")).alias("value"))
    lines.unionByName(lines).write.text(f"{folder}/edges")
    cli.convert(spark, f"{folder}/edges", f"{folder}/graph.csr.bin", directed=True, weighted=True)
    return csr_binary.read_csr(spark, f"{folder}/graph.csr").select(F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx"), "w")


def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = graph.graph_type(fx.copurchase(spark, sf_dir)).collect()[0]
    path = scratch_path(spark, "metadata")
    artifacts.write_metadata(spark, path, shape["n_vertices"], shape["nnz"], "copurchase.txt")
    return artifacts.read_json(spark, path, artifacts.METADATA)


def metrics_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.copurchase(spark, sf_dir)
    path = scratch_path(spark, "metrics")
    made = artifacts.metrics_row(spark, centrality.power_iteration(_plain(e)), artifacts.dataset_name("a/web.csr.bin"), e, "power", 1000, 1e-6, k=10, input_file="web.txt", csr_file="web.csr")
    artifacts.write_metrics(made, path)
    read = artifacts.read_json(spark, path, artifacts.METRICS)
    return read.select(
        "dataset", "num_nodes", "num_edges", "nnz", "method", "graph_type", "iterations", "top_k", "input_file", "csr_file", "max_degree", "min_degree",
        F.round("density", 9).alias("density"), F.round("avg_degree", 6).alias("avg_degree"), F.round("csr_mb", 6).alias("csr_mb"),
        (F.abs(F.col("gflops") - 2e-9 * F.col("edges_per_second")) < 1e-9).alias("rates_agree"),
    )


def scores_by_node_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-node")
    artifacts.write_scores(_final(spark, sf_dir), path, ("node_id", "centrality_score"), by_score=False, digits=10)
    return artifacts.read_csv(spark, path, "node_id long, centrality_score double").select("node_id", F.round("centrality_score", 5).alias("centrality_score"))


def scores_ranked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ranked")
    artifacts.write_scores(_final(spark, sf_dir), path, ("NodeID", "Score"))
    return artifacts.read_csv(spark, path, "NodeID long, Score double").select(F.col("NodeID").alias("node_id"), F.round("Score", 6).alias("score"))


def lanczos_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basis of 50 vectors from the seeded random start against power iteration: vertices, and do they rate them alike?"""
    g = _plain(_copurchase(spark, sf_dir))
    out = ranking.compare_scores(centrality.power_iteration(g, tol=1e-10).scores, centrality.lanczos(g, m=50, seed=42).scores)
    return out.select("n_both", "n_one", (F.col("max_difference") < 1e-5).alias("alike"))


def _with_edges(edges: str, body: str) -> str:
    return f"WITH e AS ({edges}) {body}"


_UNION = "SELECT src AS id FROM e UNION SELECT dst FROM e"
_HANDOFF = f"SELECT * FROM ({fx.HANDOFF}) WHERE src <> dst"
_HANDOFF_1 = f"SELECT src, dst, 1.0::DOUBLE AS w FROM ({_HANDOFF})"
_DEGREES = "SELECT src AS id, count(*)::BIGINT AS d FROM e GROUP BY 1"
_ROWS = f"r AS (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx, id AS node_id, (sum(d) OVER (ORDER BY id) - d)::BIGINT AS row_start, d AS degree FROM ({_DEGREES}))"
_CODED = f"i AS ({INDEX}), c AS (SELECT a.idx AS src_idx, b.idx AS dst_idx FROM e JOIN i a ON e.src = a.node_id JOIN i b ON e.dst = b.node_id)"

_WEIGHTED = (
    f"WITH e AS ({fx.TRADE_NO_LOOPS}), i AS (SELECT id AS node_id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx FROM ({_UNION})) "
    "SELECT a.idx AS src_idx, b.idx AS dst_idx, e.w * {times} AS w FROM e JOIN i a ON e.src = a.node_id JOIN i b ON e.dst = b.node_id"
)

CASES: dict[str, tuple[Query, str]] = {
    "edge_list_parse": (edge_list_parse, f"SELECT src, dst FROM ({fx.HANDOFF})"),
    "self_loop_filter": (self_loop_filter, fx.TRADE_NO_LOOPS),
    "symmetrize_dedupe": (symmetrize_dedupe, _with_edges(_HANDOFF, "SELECT src, dst FROM e UNION SELECT dst, src FROM e")),
    "vertex_set": (vertex_set, _with_edges(_HANDOFF, "SELECT src AS node_id FROM e UNION SELECT dst FROM e")),
    "unit_weights": (unit_weights, f"SELECT src, dst, 1.0::DOUBLE AS w FROM ({fx.TRADE})"),
    "weight_drop": (weight_drop, f"SELECT src, dst, 1.0::DOUBLE AS w FROM ({fx.TRADE})"),
    "copurchase_edges": (copurchase_edges, f"SELECT src, dst FROM ({fx.COPURCHASE})"),
    "compact_id_map": (compact_id_map, _with_edges(fx.COPURCHASE, INDEX)),
    "encode_edges": (encode_edges, f"WITH e AS ({fx.COPURCHASE}), {_CODED} SELECT * FROM c"),
    "decode_ids": (decode_ids, f"WITH e AS ({fx.COPURCHASE}), {_CODED} SELECT i.node_id, sum(dst_idx)::BIGINT AS total FROM c JOIN i ON c.src_idx = i.idx GROUP BY 1"),
    "adjacency_lists": (adjacency_lists, _with_edges(fx.COPURCHASE, "SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors, count(*)::BIGINT AS degree FROM e GROUP BY src")),
    "csr_row_ptr": (csr_row_ptr, f"WITH e AS ({fx.COPURCHASE}), {_ROWS} SELECT idx, node_id, row_start, degree FROM r"),
    "csr_col_idx": (csr_col_idx, f"WITH e AS ({fx.COPURCHASE}), {_CODED} SELECT (row_number() OVER (ORDER BY src_idx, dst_idx) - 1)::BIGINT AS pos, dst_idx AS col_idx FROM c"),
    "csr_to_coo": (csr_to_coo, f"WITH e AS ({fx.COPURCHASE}), {_CODED}, {_ROWS}, p AS (SELECT (row_number() OVER (ORDER BY src_idx, dst_idx) - 1)::BIGINT AS pos, dst_idx FROM c) SELECT r.idx AS src_idx, p.dst_idx FROM r JOIN p ON p.pos >= r.row_start AND p.pos < r.row_start + r.degree"),
    "csr_invariants": (csr_invariants, _with_edges(fx.COPURCHASE, "SELECT count(DISTINCT src)::BIGINT AS n, count(*)::BIGINT AS nnz, count(*)::BIGINT AS \"end\", true AS valid FROM e")),
    "graph_type_check": (graph_type_check, _with_edges(_HANDOFF, f"SELECT (SELECT count(*) FROM ({_UNION}))::BIGINT AS n_vertices, count(*)::BIGINT AS nnz, count(*) FILTER (WHERE r.src IS NULL)::BIGINT AS n_one_way, count(*) FILTER (WHERE r.src IS NULL) = 0 AS symmetric FROM e LEFT JOIN e r ON e.src = r.dst AND e.dst = r.src")),
    "degree": (degree, _with_edges(_HANDOFF, f"SELECT v.id AS node_id, count(e.src)::BIGINT AS degree FROM ({_UNION}) v LEFT JOIN e ON e.src = v.id GROUP BY 1")),
    "degree_stats": (degree_stats, _with_edges(fx.COPURCHASE, f"SELECT round(avg(d), 6) AS avg_degree, max(d) AS max_degree, min(d) AS min_degree FROM ({_DEGREES})")),
    "graph_stats": (graph_stats, _with_edges(fx.COPURCHASE, f"SELECT count(*)::BIGINT AS n, sum(d)::BIGINT AS nnz, (sum(d) // 2)::BIGINT AS num_edges, round(sum(d)::DOUBLE / (count(*)::DOUBLE * count(*)), 9) AS density, round(4.0::DOUBLE * (count(*) + 1 + 2 * sum(d)) / 1e6, 6) AS csr_mb FROM ({_DEGREES})")),
    "vector_norm": (vector_norm, f"SELECT round(sqrt(sum(x * x)), 6) AS norm FROM ({DEGREES})"),
    "vector_dot": (vector_dot, f"SELECT round(sum(x * id), 3) AS dot FROM ({DEGREES})"),
    "vector_axpy": (vector_axpy, f"SELECT id, round(x - 0.5::DOUBLE * id, 6) AS x FROM ({DEGREES})"),
    **{f"residual_{k}" if k != "max_abs" else k: (_residual(k), sql.power(fx.COPURCHASE, v, max_iter=2, fixed=True)) for k, v in RESIDUAL.items()},
    "spmv_unweighted": (_product(fx.copurchase, "out", False), _product_sql(fx.COPURCHASE, "out", False)),
    "spmv_weighted": (_product(fx.trade, "out", True), _product_sql(fx.TRADE, "out", True)),
    "spmv_in": (_product(fx.handoff, "in", True), _product_sql(fx.HANDOFF, "in", True)),
    "power_fixed_k": (_power(fx.copurchase, _plain, max_iter=20, tol=0.0), sql.power(fx.COPURCHASE, SCORE, max_iter=20, fixed=True)),
    "evc_l2": (_power(fx.copurchase, _plain), sql.power(fx.COPURCHASE, SCORE)),
    "evc_l1": (_power(fx.copurchase, _plain, criterion="l1"), sql.power(fx.COPURCHASE, SCORE, "l1")),
    "evc_mean_l1": (_power(fx.copurchase, _plain, criterion="mean_l1"), sql.power(fx.COPURCHASE, SCORE, "mean_l1")),
    "evc_l1_n_shift": (_power(fx.copurchase, _plain, criterion="l1_n", shift=True), sql.power(fx.COPURCHASE, SCORE, "l1_n", shift=True)),
    "evc_tables": (power_tables, sql.power(fx.COPURCHASE, SCORE)),
    "evc_weighted_directed": (_power(fx.trade, lambda e: graph.directed(e, "w"), direction="in"), sql.power(fx.TRADE_NO_LOOPS, SCORE, direction="in")),
    "evc_directed_in": (_power(fx.handoff, graph.directed, direction="in"), sql.power(_HANDOFF_1, SCORE, direction="in")),
    "evc_directed_out": (_power(fx.handoff, graph.directed), sql.power(_HANDOFF_1, SCORE)),
    "evc_reference": (evc_reference, sql.power(_HANDOFF_1, SCORE, "l1_n", shift=True, direction="in")),
    "evc_bipartite_shift_fixed_k": (_power(fx.customer_supplier, _plain, max_iter=20, tol=0.0, shift=True), sql.power(fx.CUSTOMER_SUPPLIER, SCORE, max_iter=20, shift=True, fixed=True)),
    "evc_bipartite_nonconvergence": (evc_bipartite_nonconvergence, sql.power(fx.CUSTOMER_SUPPLIER, "SELECT count(*)::BIGINT AS n, max(k)::BIGINT AS iterations, max(l2) <= 1e-6 AS converged, round(max(l2), 6) AS residual FROM last", max_iter=20)),
    "lanczos_coefficients": (lanczos_coefficients, sql.lanczos(fx.COPURCHASE, 6, "SELECT j::BIGINT AS j, round(alpha, 5) AS alpha, round(beta, 5) AS beta FROM c")),
    "lanczos_centrality": (lanczos_centrality, sql.power(fx.COPURCHASE, "SELECT id AS node_id, round(x, 5) AS score FROM last", tol=1e-10)),
    "dominant_eigenvalue": (dominant_eigenvalue, sql.power(fx.COPURCHASE, "SELECT round(sum(a.x * e.w * b.x), 6) AS eigenvalue FROM e JOIN last a ON e.src = a.id JOIN last b ON e.dst = b.id", max_iter=30, fixed=True)),
    "score_sum": (score_sum, sql.power(fx.COPURCHASE, "SELECT round(sum(x), 5) AS score_sum FROM last")),
    "top_node": (top_node, sql.power(fx.COPURCHASE, "SELECT id AS top_node, round(x, 6) AS top_score FROM last ORDER BY x DESC, id LIMIT 1")),
    "top20": (top20, sql.power(fx.COPURCHASE, f"SELECT * FROM ({RANKED}) WHERE rank <= 20")),
    "full_ranking": (full_ranking, sql.power(fx.COPURCHASE, RANKED)),
    "compare_methods": (compare_methods, f"SELECT count(DISTINCT src)::BIGINT AS n_both, 0::BIGINT AS n_one, true AS alike FROM ({fx.COPURCHASE})"),
    "sign_clamp": (sign_clamp, SIGN_CLAMP),
    "csr_binary_roundtrip": (csr_binary_roundtrip, fx.COPURCHASE),
    "csr_binary_unweighted": (csr_binary_unweighted, f"WITH e AS ({fx.COPURCHASE}), {_CODED} SELECT *, 1.0::DOUBLE AS w FROM c"),
    "csr_pack": (csr_pack, _WEIGHTED.format(times=1)),
    "convert_weighted": (convert_weighted, _WEIGHTED.format(times=2)),
    "metadata_roundtrip": (metadata_roundtrip, _with_edges(fx.COPURCHASE, f"SELECT (SELECT count(*) FROM ({_UNION}))::BIGINT AS num_nodes, count(*)::BIGINT AS num_edges, ((SELECT count(*) FROM ({_UNION})) + 1)::BIGINT AS indptr_length, count(*)::BIGINT AS indices_length, count(*)::BIGINT AS data_length, 'copurchase.txt' AS input_file FROM e")),
    "metrics_fields": (metrics_fields, sql.power(fx.COPURCHASE, f"SELECT 'web' AS dataset, count(*)::BIGINT AS num_nodes, (sum(d) // 2)::BIGINT AS num_edges, sum(d)::BIGINT AS nnz, 'power' AS method, 'undirected' AS graph_type, (SELECT max(k) FROM last)::BIGINT AS iterations, 10::BIGINT AS top_k, 'web.txt' AS input_file, 'web.csr' AS csr_file, max(d) AS max_degree, min(d) AS min_degree, round(sum(d)::DOUBLE / (count(*)::DOUBLE * count(*)), 9) AS density, round(avg(d), 6) AS avg_degree, round(4.0::DOUBLE * (count(*) + 1 + 2 * sum(d)) / 1e6, 6) AS csr_mb, true AS rates_agree FROM ({_DEGREES})")),
    "scores_by_node_csv": (scores_by_node_csv, sql.power(fx.COPURCHASE, "SELECT id AS node_id, round(x, 5) AS centrality_score FROM last")),
    "scores_ranked_csv": (scores_ranked_csv, sql.power(fx.COPURCHASE, "SELECT id AS node_id, round(x, 6) AS score FROM last")),
    "lanczos_default": (lanczos_default, f"SELECT count(DISTINCT src)::BIGINT AS n_both, 0::BIGINT AS n_one, true AS alike FROM ({fx.COPURCHASE})"),
    "csr_text_roundtrip": (csr_text_roundtrip, f"WITH e AS ({fx.COPURCHASE}), {_CODED} SELECT * FROM c"),
    "csv_json_roundtrip": (csv_json_roundtrip, sql.power(fx.COPURCHASE, f"SELECT rank, node_id, score, true AS same, (SELECT n FROM n)::BIGINT AS num_nodes, (SELECT count(*) FROM e)::BIGINT AS nnz, (SELECT max(k) FROM last)::BIGINT AS iterations, true AS converged, first_value(node_id) OVER (ORDER BY rank) AS top_node FROM ({RANKED}) WHERE rank <= 20")),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CASES.items()}
