"""Command line: convert, pack, solve, reference and lanczos."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.scratch import materialise
from .operators import centrality, graph
from .sources import artifacts, csr_binary, edge_text


def read_text(spark: SparkSession, path: str, directed: bool, weighted: bool) -> graph.Graph:
    """The graph of an edge list; weights (of directed graphs) are summed over equal pairs."""
    if weighted and not directed:
        raise ValueError("weights need --directed")
    edges = edge_text.read_edges(spark, path, weighted=weighted)
    return graph.directed(edges, "w" if weighted else None) if directed else graph.undirected(edges)


def convert(spark: SparkSession, source: str, target: str, directed: bool = False, weighted: bool = False) -> graph.Graph:
    """Edge list to a binary CSR file, undirected unless told otherwise."""
    made = read_text(spark, source, directed, weighted)
    made = graph.Graph(materialise(made.edges, "edges"), made.directed, made.weighted)
    index = graph.vertex_index(made.edges)
    csr_binary.write_csr(graph.csr_rows(made.edges), graph.csr_columns(made.edges, index), artifacts.csr_name(target))
    return made


def solve(spark: SparkSession, path: str, folder: str, args: argparse.Namespace, method: str) -> centrality.Result:
    """Scores, top nodes and metrics of a binary CSR file or an edge list."""
    binary = path.endswith((".csr", ".bin"))
    if binary:
        made = graph.Graph(csr_binary.read_csr(spark, path, not args.unweighted), directed=args.directed, weighted=not args.unweighted)
    else:
        made = read_text(spark, path, args.directed, args.weighted)
    if method == "lanczos":
        result = centrality.lanczos(made, args.basis, args.seed)
    elif method == "reference":
        result = centrality.reference_centrality(made, args.max_iter, args.tol)
    else:
        result = centrality.power_iteration(made, args.max_iter, args.tol, args.criterion, args.shift, args.direction)
    name = artifacts.dataset_name(path)
    out = artifacts.OutputPaths.of(folder, name, args.top_k)
    artifacts.write_scores(result.scores, out.scores)
    artifacts.write_top(result.scores, out.top, args.top_k)
    files = {"csr_file" if binary else "input_file": path}
    artifacts.write_metrics(artifacts.metrics_row(spark, result, name, made.edges, method, args.max_iter, args.tol, args.directed, args.top_k, **files), out.metrics)
    print(artifacts.report(result, args.top_k))
    return result


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orbitmill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--directed", action="store_true")
    c.add_argument("--weighted", action="store_true", help="the third column is the weight")
    a = sub.add_parser("pack")
    a.add_argument("indptr")
    a.add_argument("indices")
    a.add_argument("target")
    a.add_argument("--data")
    for name in ("solve", "reference", "lanczos"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("max_iter", nargs="?", type=int, default=1000)
        s.add_argument("tol", nargs="?", type=float, default=1e-6)
        s.add_argument("top_k", nargs="?", type=int, default=20)
        s.add_argument("--out", default="results")
        s.add_argument("--criterion", default="l2", choices=["l2", "l1", "mean_l1", "l1_n"])
        s.add_argument("--direction", default="out", choices=["out", "in"])
        s.add_argument("--shift", action="store_true")
        s.add_argument("--directed", action="store_true")
        s.add_argument("--unweighted", action="store_true", help="of a binary file, without its weights")
        s.add_argument("--weighted", action="store_true", help="of an edge list, with its third column")
        s.add_argument("--basis", type=int, default=50)
        s.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("orbitmill").getOrCreate()
    if args.command == "convert":
        convert(spark, args.source, args.target, args.directed, args.weighted)
    elif args.command == "pack":
        artifacts.pack(spark, args.indptr, args.indices, artifacts.csr_name(args.target), args.data)
    else:
        solve(spark, args.path, args.out, args, args.command)


if __name__ == "__main__":
    main()
