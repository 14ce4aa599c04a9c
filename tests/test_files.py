import json
import struct

import pytest

from orbitmill import cli
from orbitmill.operators import graph
from orbitmill.operators.prefix import dense_index, running_sum
from orbitmill.sources import artifacts, csr_binary, edge_text

TEXT = "# a comment\n1 2\n  2\t3  99 \n\n4\n3 3\n1 2\n   # 5 6\n"


@pytest.fixture
def text_file(tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text(TEXT)
    return str(path)


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_edge_text(spark, text_file, tmp_path):
    assert pairs(edge_text.read_edges(spark, text_file)) == [(1, 2), (1, 2), (2, 3), (3, 3)]
    bad = tmp_path / "bad.txt"
    bad.write_text("1 2\na b\n")
    assert pairs(edge_text.read_edges(spark, str(bad), permissive=True)) == [(1, 2)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        edge_text.read_edges(spark, str(bad)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        edge_text.read_edges(spark, str(tmp_path / "none")).collect()


def test_running_sums_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7 as k", "id % 5 as v")
    rows = sorted(running_sum(df.repartition(4), "k", "v", "s").collect(), key=lambda r: r["k"])
    total = 0
    for r in rows:
        assert r["s"] == total
        total += r["v"]
    assert [r["idx"] for r in sorted(dense_index(df, "k").collect(), key=lambda r: r["k"])] == list(range(1000))


def test_csr_file_layout_and_round_trip(spark, tmp_path):
    g = graph.undirected(spark.createDataFrame([(10, 20), (20, 40), (10, 10)], "src long, dst long"))
    index = graph.vertex_index(g.edges)
    path = str(tmp_path / "g.csr")
    assert csr_binary.write_csr(graph.csr_rows(g.edges), graph.csr_columns(g.edges, index), path) == (3, 4)
    data = open(path, "rb").read()
    assert struct.unpack("<ii4i4i4f", data) == (3, 4, 0, 1, 3, 4, 1, 0, 2, 1, 1.0, 1.0, 1.0, 1.0)
    for parts in (1, 2, 8):
        assert pairs(csr_binary.read_csr(spark, path, partitions=parts)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    short = str(tmp_path / "u.csr")
    csr_binary.write_csr(graph.csr_rows(g.edges), graph.csr_columns(g.edges, index), short, weighted=False)
    assert len(open(short, "rb").read()) == len(data) - 16
    assert pairs(csr_binary.read_csr(spark, short, weighted=False)) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_truncated_csr_is_an_error(tmp_path):
    path = tmp_path / "t.csr"
    for data in (b"", b"\1\0\0\0", struct.pack("<ii2i", 1, 3, 0, 3)):
        path.write_bytes(data)
        with pytest.raises(ValueError):
            csr_binary.read_header(str(path), True)
    with pytest.raises(FileNotFoundError):
        csr_binary.read_header(str(tmp_path / "none"), True)


def test_isolated_rows_keep_width_zero(spark):
    g = graph.directed(spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long"))
    rows = sorted(map(tuple, graph.csr_rows(g.edges).collect()))
    assert rows == [(0, 1, 0, 1), (1, 2, 1, 0), (2, 3, 1, 1)]
    checks = graph.csr_checks(graph.csr_rows(g.edges), graph.csr_columns(g.edges, graph.vertex_index(g.edges))).collect()[0]
    assert checks["valid"] and checks["end"] == 2


def test_metadata_and_names(spark, tmp_path):
    artifacts.write_metadata(spark, str(tmp_path / "m"), 5, 8, "x.txt")
    row = artifacts.read_json(spark, str(tmp_path / "m"), artifacts.METADATA).collect()[0]
    assert (row["num_nodes"], row["indptr_length"], row["data_length"]) == (5, 6, 8)
    assert artifacts.dataset_name("/a/b/web.csr.bin") == artifacts.dataset_name("web.txt") == "web"
    assert artifacts.csr_name("a.csr.bin") == "a.csr"


def test_score_files(spark, tmp_path):
    s = spark.createDataFrame([(2, 0.25), (1, 0.5)], "node_id long, score double")
    artifacts.write_scores(s, str(tmp_path / "a"), ("NodeID", "Score"), digits=8)
    artifacts.write_scores(s, str(tmp_path / "b"), ("node_id", "centrality_score"), by_score=False)
    read = lambda p: next((tmp_path / p).glob("part-*.csv")).read_text()
    assert read("a") == "NodeID,Score\n1,0.50000000\n2,0.25000000\n"
    assert read("b").splitlines()[0] == "node_id,centrality_score"


def test_command_line(spark, text_file, tmp_path, capsys):
    csr = str(tmp_path / "g.csr.bin")
    cli.main(["convert", text_file, csr], spark)
    out = str(tmp_path / "out")
    for command in ("solve", "reference", "lanczos"):
        cli.main([command, str(tmp_path / "g.csr"), "50", "1e-6", "2", "--out", out], spark)
    assert "rank" in capsys.readouterr().out
    metrics = json.loads(next((tmp_path / "out" / "g_metrics.json").glob("part-*.json")).read_text())
    assert metrics["num_nodes"] == 3 and metrics["nnz"] == 4
    assert len(next((tmp_path / "out" / "g_top2.csv").glob("part-*.csv")).read_text().splitlines()) == 3


def test_pack_checks_its_arrays(spark, tmp_path):
    def write(name, numbers):
        (tmp_path / name).write_text("\n".join(map(str, numbers)) + "\n")
        return str(tmp_path / name)

    indptr, indices, data = write("indptr", [0, 1, 3]), write("indices", [1, 0, 1]), write("data", [0.5, 2, 4])
    cli.main(["pack", indptr, indices, str(tmp_path / "p.csr.bin"), "--data", data], spark)
    read = csr_binary.read_csr(spark, str(tmp_path / "p.csr"))
    assert sorted(map(tuple, read.collect())) == [(0, 1, 0.5), (1, 0, 2.0), (1, 1, 4.0)]
    for bad in ((write("a", [0, 1, 4]), indices, None), (indptr, write("b", [1, 0, 2]), None), (write("c", [0, 3, 2, 3]), indices, None), (indptr, write("d", [1, -1, 0]), None), (indptr, indices, write("e", [1.0]))):
        with pytest.raises(ValueError):
            artifacts.pack(spark, bad[0], bad[1], str(tmp_path / "q.csr"), bad[2])


def test_weights_of_text(spark, tmp_path, text_file):
    path = tmp_path / "w.txt"
    path.write_text("1 2 0.5\n1 2 2\n2 1\n3 3 9\n")
    cli.main(["convert", str(path), str(tmp_path / "w.csr"), "--directed", "--weighted"], spark)
    assert sorted(map(tuple, csr_binary.read_csr(spark, str(tmp_path / "w.csr")).collect())) == [(0, 1, 2.5), (1, 0, 1.0)]
    cli.main(["solve", str(path), "20", "1e-6", "2", "--out", str(tmp_path / "out"), "--directed", "--weighted"], spark)
    metrics = json.loads(next((tmp_path / "out" / "w_metrics.json").glob("part-*.json")).read_text())
    assert (metrics["graph_type"], metrics["num_edges"], metrics["max_degree"], metrics["top_k"], metrics["input_file"]) == ("directed", 2, 1, 2, str(path))
    assert metrics["gflops"] > 0 and metrics["gigabytes_per_second"] > 0
    with pytest.raises(ValueError):
        cli.read_text(spark, str(path), False, True)


def test_positions_meet_their_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_POSITIONS", 4)
    degree = [0, 1, 11, 0, 3, 4, 0]  # a row over several blocks, rows that end with one, empty ones
    rows, columns, expected, at = [], [], [], 0
    for i, d in enumerate(degree):
        rows.append((i, 10 * i, at, d))
        expected += [(i, 100 * i + k) for k in range(d)]
        columns += [(at + k, 100 * i + k) for k in range(d)]
        at += d
    made = graph.csr_to_edges(spark.createDataFrame(rows, "idx long, node_id long, row_start long, degree long").repartition(3), spark.createDataFrame([*columns, (at, 5)], "pos long, col_idx long").repartition(4))
    assert sorted(map(tuple, made.collect())) == expected
    assert "Broadcast" not in made._jdf.queryExecution().toString()
    assert graph.csr_to_edges(spark.createDataFrame([], "idx long, row_start long, degree long"), spark.createDataFrame([], "pos long, col_idx long")).count() == 0


def test_arrays_in_several_files_and_splits(spark, tmp_path):
    values = spark.range(500).selectExpr("id as pos", "id * 3 as value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        artifacts.write_array(values.repartition(7), str(tmp_path / "a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "a").glob("part-*"))
    assert len(parts) > 1  # no task wrote them all
    (tmp_path / "one.txt").write_text("  " + " ".join(map(str, range(0, 300, 3))) + "\n\n" + "\n".join(map(str, range(300, 1500, 3))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        for path in ("a", "one.txt"):
            read = artifacts.read_array(spark, str(tmp_path / path))
            assert sorted(map(tuple, read.collect())) == [(i, 3 * i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csr_is_written_in_pieces_from_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csr_binary, "BATCH", 4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(11).selectExpr("id as idx", "id * 3 as row_start", "3L as degree")
    columns = spark.range(33).selectExpr("id as pos", "(id * 7) % 11 as col_idx", "id / 2.0d as w").repartition(5)
    path = str(tmp_path / "g.csr")
    assert csr_binary.write_csr(rows, columns.mapInArrow(counted, columns.schema), path) == (11, 33)
    expected = struct.pack("<ii12i33i33f", 11, 33, *range(0, 36, 3), *((i * 7) % 11 for i in range(33)), *(i / 2 for i in range(33)))
    assert open(path, "rb").read() == expected
    assert seen.value == 33
