"""SQL of iterative queries, as recursive queries."""

from __future__ import annotations

STOPS = {
    "l2": "p.l2 <= {tol}",
    "l1": "p.l1 < {tol}",
    "mean_l1": "p.l1 / (SELECT n FROM n) <= 0.1 * {tol}",
    "l1_n": "p.l1 < (SELECT n FROM n) * {tol}",
}


def power(edges: str, tail: str, criterion: str = "l2", tol: float = 1e-6, max_iter: int = 1000, shift: bool = False, direction: str = "out", fixed: bool = False) -> str:
    """Power iteration over the edges; ``it`` holds (k, id, x, l1, l2) of every step for the query's tail."""
    row, col = ("src", "dst") if direction == "out" else ("dst", "src")
    go_on = f"p.k < {max_iter}" + ("" if fixed else f" AND (p.k = 0 OR NOT ({STOPS[criterion].format(tol=tol)}))")
    y = "coalesce(s.y, 0.0)" + (" + p.x" if shift else "")
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({edges}),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v),
it(k, id, x, l1, l2) AS (
  SELECT 0, id, 1.0 / sqrt((SELECT n FROM n)), 0.0::DOUBLE, 0.0::DOUBLE FROM v
  UNION ALL
  SELECT k + 1, id, y / norm, sum(abs(y / norm - x)) OVER (), sqrt(sum((y / norm - x) * (y / norm - x)) OVER ())
  FROM (
    SELECT p.k, p.id, p.x, {y} AS y, sqrt(sum(({y}) * ({y})) OVER ()) AS norm
    FROM it p LEFT JOIN (SELECT e.{row} AS id, sum(e.w * t.x) AS y FROM e JOIN it t ON e.{col} = t.id GROUP BY e.{row}) s ON p.id = s.id
    WHERE {go_on}
  )
),
last AS (SELECT * FROM it WHERE k = (SELECT max(k) FROM it))
{tail}
"""


def lanczos(edges: str, m: int, tail: str) -> str:
    """Lanczos coefficients from a uniform start; ``c`` holds (j, alpha, beta)."""
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({edges}),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
it(j, id, v, before, alpha, beta) AS (
  SELECT 0, id, 1.0 / sqrt((SELECT count(*) FROM v)), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM v
  UNION ALL
  SELECT j + 1, id, r / norm, v, a, norm FROM (
    SELECT *, sqrt(sum(r * r) OVER ()) AS norm FROM (
      SELECT *, y - a * v - beta * before AS r FROM (
        SELECT p.*, coalesce(s.y, 0.0) AS y, sum(p.v * coalesce(s.y, 0.0)) OVER () AS a
        FROM it p LEFT JOIN (SELECT e.src AS id, sum(e.w * t.v) AS y FROM e JOIN it t ON e.dst = t.id GROUP BY e.src) s ON p.id = s.id
        WHERE p.j < {m}
      )
    )
  )
),
c AS (SELECT DISTINCT j, alpha, beta FROM (SELECT j, first_value(alpha) OVER w AS alpha, first_value(beta) OVER w AS beta FROM it WHERE j > 0 WINDOW w AS (PARTITION BY j ORDER BY id)))
{tail}
"""
