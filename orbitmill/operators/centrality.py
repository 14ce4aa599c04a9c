"""Eigenvector centrality by power iteration and by Lanczos' method."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .spaces import BlockSpace, TableSpace, space_of

SCORES = "node_id long, score double"


@dataclass
class Result:
    """Scores (node_id, score) and how the run went; the scores of a run that did not converge are its last ones."""

    scores: DataFrame
    converged: bool
    iterations: int
    residual: float
    eigenvalue: float
    n: int
    runtime_seconds: float
    alpha: list[float] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)

    @property
    def seconds_per_iteration(self) -> float:
        return self.runtime_seconds / self.iterations if self.iterations else 0.0

    def edges_per_second(self, nnz: int) -> float:
        return nnz * self.iterations / self.runtime_seconds if self.runtime_seconds else 0.0

    def gflops(self, nnz: int) -> float:
        """A multiplication and an addition for each edge and iteration."""
        return 2e-9 * self.edges_per_second(nnz)

    def gigabytes_per_second(self, nnz: int, edge_numbers: int = 2, vectors: int = 2) -> float:
        """By a model of numbers of four bytes: so many for each edge, row starts, and so many vectors."""
        each = 4 * (edge_numbers * nnz + self.n + 1 + vectors * self.n)
        return 1e-9 * each * self.iterations / self.runtime_seconds if self.runtime_seconds else 0.0


def stopped(criterion: str, l1: float, l2: float, n: int, tol: float) -> bool:
    """Whether a step's change is small enough, by one of four rules."""
    if criterion == "l2":
        return l2 <= tol
    if criterion == "l1":
        return l1 < tol
    if criterion == "mean_l1":
        return l1 / n <= 0.1 * tol
    if criterion == "l1_n":
        return l1 < n * tol
    raise ValueError(f"unknown criterion {criterion!r}")


def _empty(spark: SparkSession, began: float) -> Result:
    return Result(spark.createDataFrame([], SCORES), True, 0, 0.0, 0.0, 0, time.perf_counter() - began)


def power_iteration(
    graph: Graph,
    max_iter: int = 1000,
    tol: float = 1e-6,
    criterion: str = "l2",
    shift: bool = False,
    direction: str = "out",
    strategy: str = "auto",
) -> Result:
    """The leading eigenvector of A (with ``shift`` of A + I) from a uniform start.

    A zero product ends the run unconverged with the last vector; a graph
    without edges gives an empty, converged result.
    """
    began = time.perf_counter()
    stopped(criterion, 0.0, 0.0, 1, tol)
    space = space_of(graph, direction, shift, strategy)
    try:
        if not space.n:
            return _empty(graph.edges.sparkSession, began)
        x, residual, converged, step = space.uniform(), float("inf"), False, 0
        while step < max_iter and not converged:
            x, size, l1, l2 = space.step(x)
            if size == 0.0:
                break
            residual = l2 if criterion == "l2" else l1 / space.n if criterion == "mean_l1" else l1
            step += 1
            converged = stopped(criterion, l1, l2, space.n, tol)
        value = _rayleigh(space, x) - (1.0 if shift else 0.0)
        return Result(space.scores(x), converged, step, residual, value, space.n, time.perf_counter() - began)
    finally:
        space.close()


def _rayleigh(space: BlockSpace | TableSpace, x) -> float:
    """x' A x of a vector of norm 1, with the space's shift in A."""
    return space.dot(x, space.product(x))


def reference_centrality(graph: Graph, max_iter: int = 1000, tol: float = 1e-6, strategy: str = "auto") -> Result:
    """A + I over edges in, until the mean change is below tol; weights are not used."""
    plain = Graph(graph.edges.select("src", "dst").withColumn("w", F.lit(1.0)), graph.directed)
    return power_iteration(plain, max_iter, tol, "l1_n", shift=True, direction="in", strategy=strategy)


def tridiagonal_leader(alpha: list[float], beta: list[float], steps: int = 1000) -> tuple[float, np.ndarray]:
    """Eigenvalue of largest size and its vector, of the symmetric tridiagonal matrix, by ``steps`` power steps."""
    m = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
    y = np.full(m, 1.0 / np.sqrt(m))
    for _ in range(steps):
        z = t @ y
        size = np.linalg.norm(z)
        if size == 0.0:
            break
        y = z / size
    return float(y @ t @ y), y


def lanczos(graph: Graph, m: int = 50, seed: int | None = 42, direction: str = "out", breakdown: float = 1e-6, reorthogonalize: bool = False, strategy: str = "auto") -> Result:
    """Centrality from a Krylov basis of at most ``m`` vectors.

    ``seed`` None starts uniform. A step's residual norm below ``breakdown``
    ends the basis. The vector is signed by its largest entry, scaled to norm 1
    and cleared of negative noise.
    """
    began = time.perf_counter()
    space = space_of(graph, direction, False, strategy)
    try:
        if not space.n:
            return _empty(graph.edges.sparkSession, began)
        basis = [space.uniform() if seed is None else space.random(seed)]
        alpha: list[float] = []
        beta: list[float] = []
        done = False
        for j in range(min(m, space.n)):
            w = space.product(basis[j])
            alpha.append(space.dot(basis[j], w))
            parts = [(1.0, w), (-alpha[j], basis[j])]
            if j:
                parts.append((-beta[j - 1], basis[j - 1]))
            w = space.combined(parts)
            if reorthogonalize:
                w = space.combined([(1.0, w), *[(-space.dot(v, w), v) for v in basis]])
            beta.append(space.norm(w))
            done = beta[j] < breakdown
            if done or j + 1 == min(m, space.n):
                break
            basis.append(space.combined([(1.0 / beta[j], w)], keep=True))
        value, y = tridiagonal_leader(alpha, beta)
        x = space.signed(space.combined([(float(f), v) for f, v in zip(y, basis, strict=True)]))
        size = space.norm(x)
        x = space.combined([(1.0 / size if size else 1.0, x)])
        noise = (F.col("score") < 0) & (F.col("score") > -1e-6)
        scores = space.scores(x).withColumn("score", F.when(noise, 0.0).otherwise(F.col("score")))
        residual = float(abs(beta[len(alpha) - 1] * y[-1]))
        return Result(scores, done or residual <= 1e-6, len(alpha), residual, value, space.n, time.perf_counter() - began, alpha, beta)
    finally:
        space.close()
