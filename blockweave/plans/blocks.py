"""Queries over blocks of unequal size with entries off the diagonal, and closed forms of the likelihood on small ones.

Systems are solved in SQL by Jacobi's iteration, which halves the error at least in each of its steps on these diagonally dominant blocks.
Workflows whose steps SQL can't take (greedy clumping, determinants) are tested against dense algebra in tests/test_blocks.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.operators import precision, workflows
from blockweave.plans.fixtures import cte, view
from blockweave.plans.registry import _PAIR, _pair_annotations, _pair_tables, query

_TRI = cte("tri_nodes", "tri_near", "tri_far").replace("WITH ", "WITH RECURSIVE ", 1) + """
  , s AS (SELECT e.* FROM (SELECT * FROM tri_near UNION ALL SELECT * FROM tri_far) e SEMI JOIN tri_nodes n ON n.block_id = e.block_id AND n.i = e.j)
  , off AS (SELECT * FROM s UNION ALL SELECT block_id, j, i, value FROM s UNION ALL SELECT block_id, i, i, 0 FROM tri_nodes) """


def _solved(name: str, right: str, steps: int = 45) -> str:
    """CTE ``name`` (block_id, i, c, y): the systems whose diagonals and right sides are ``right`` (block_id, i, c, d, x), for each c."""
    return f"""
  , {name}_it AS (
    SELECT 0 AS k, block_id, i, c, x / d AS y FROM {right}
    UNION ALL
    SELECT r.k + 1, n.block_id, n.i, n.c, (n.x - sum(o.value * r.y)) / n.d
    FROM {right} n JOIN off o ON o.block_id = n.block_id AND o.i = n.i JOIN {name}_it r ON r.block_id = o.block_id AND r.i = o.j AND r.c = n.c
    WHERE r.k < {steps} GROUP BY r.k, n.block_id, n.i, n.c, n.x, n.d)
  , {name} AS (SELECT block_id, i, c, y FROM {name}_it WHERE k = {steps}) """


def tri_matrix(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, "tri_nodes")
    edges = view(spark, d, "tri_near").union(view(spark, d, "tri_far")).join(nodes.select("block_id", F.col("i").alias("j")), ["block_id", "j"], "left_semi")
    return precision.sparse_precision(edges.select("block_id", "i", "j", "value").union(nodes.select("block_id", "i", F.col("i").alias("j"), F.col("d").alias("value"))))


def tri_rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tri_nodes").select("block_id", "row_nr", "i", "z", F.lit(1024.0).alias("n"), F.lit(True).alias("is_representative"))


@query("l3_solve_blocks", _TRI + ", b AS (SELECT block_id, i, 0 AS c, d, z AS x FROM tri_nodes)" + _solved("r", "b") + "SELECT block_id, i, round(y + 0.0, 8) AS y FROM r")
def _(spark, d):
    x = tri_rows(spark, d).select("block_id", "i", F.col("z").alias("x"))
    return precision.solve(tri_matrix(spark, d), x).select("block_id", "i", (F.round("y", 8) + 0.0).alias("y"))


@query("l9_inverse_diagonal_blocks", _TRI + ", b AS (SELECT n.block_id, n.i, m.i AS c, n.d, CAST(n.i = m.i AS INT)::DOUBLE AS x FROM tri_nodes n JOIN tri_nodes m USING (block_id))" + _solved("r", "b") + "SELECT block_id, i, round(y, 8) AS y FROM r WHERE i = c")
def _(spark, d):
    return precision.inverse_diagonal(tri_matrix(spark, d)).withColumn("y", F.round("y", 8))


@query("b2_blup_blocks", _TRI + """
  , pz AS (SELECT n.block_id, n.i, sum(o.value * m.z) + n.d * n.z AS x, n.d FROM tri_nodes n JOIN off o ON o.block_id = n.block_id AND o.i = n.i JOIN tri_nodes m ON m.block_id = o.block_id AND m.i = o.j GROUP BY n.block_id, n.i, n.d, n.z)
  , b AS (SELECT block_id, i, 0 AS c, d + 256 AS d, x FROM pz)""" + _solved("r", "b", 20) + "SELECT r.block_id, n.row_nr, round(8 * y + 0.0, 8) AS weight FROM r JOIN tri_nodes n USING (block_id, i)")
def _(spark, d):
    return precision.blup(tri_matrix(spark, d), tri_rows(spark, d), 0.25).select("block_id", "row_nr", (F.round("weight", 8) + 0.0).alias("weight"))


@query("q4_accuracy_blocks", _TRI + ", b AS (SELECT block_id, i, 0 AS c, d, z AS x FROM tri_nodes UNION ALL SELECT block_id, i, 1, d, i % 5 - 2 FROM tri_nodes)" + _solved("r", "b") + """
  , sums AS (SELECT sum(CASE c WHEN 0 THEN (i % 5 - 2) * y END) AS wt, sum(CASE c WHEN 0 THEN n.z * y END) AS ww, sum(CASE c WHEN 1 THEN (i % 5 - 2) * y END) AS tt FROM r JOIN tri_nodes n USING (block_id, i)) SELECT round(wt * wt / (ww * tt), 8) AS r2 FROM sums""")
def _(spark, d):
    rows = tri_rows(spark, d).select("block_id", "i", F.col("z").alias("weight"), (F.col("i") % 5 - 2).cast("double").alias("truth"))
    return workflows.score_accuracy(tri_matrix(spark, d), rows).withColumn("r2", F.round("r2", 8))


@query("q3_regularise_blocks", _TRI + ", b AS (SELECT block_id, i, 0 AS c, d + 3 AS d, 4 * z AS x FROM tri_nodes)" + _solved("r", "b") + "SELECT r.block_id, n.row_nr, round(y + 0.0, 8) AS z FROM r JOIN tri_nodes n USING (block_id, i)")
def _(spark, d):
    # (0.25 P + 0.75 I)^-1 z = (P + 3 I)^-1 4 z
    return workflows.regularise_z(tri_matrix(spark, d), tri_rows(spark, d), 0.25).withColumn("z", F.round("z", 8) + 0.0)


@query("l7_log_determinant_blocks")
def _(spark, d):
    return precision.log_determinant(tri_matrix(spark, d))


@query("c1_clump_blocks")
def _(spark, d):
    return precision.clump(tri_matrix(spark, d), tri_rows(spark, d), 1e-5, 4.0)


@query("q1_impute_blocks")
def _(spark, d):
    return workflows.impute_z(tri_matrix(spark, d), tri_rows(spark, d).withColumn("z", F.when(F.col("i") % 3 != 1, F.col("z"))))


@query("q2_outlier_chi2_blocks")
def _(spark, d):
    return workflows.outlier_chi2(tri_matrix(spark, d), tri_rows(spark, d).withColumn("half", F.col("i") % 2 == 0))


@query("l4_selected_matrix_blocks")
def _(spark, d):
    chosen = tri_rows(spark, d).where("i % 3 <> 1").select("block_id", "i", F.col("i").alias("ord"))
    return precision.selected_matrix(tri_matrix(spark, d), chosen)


# the two nodes' likelihood in closed form: P of the nodes that have a Z (the Schur complement where one lacks it), M = P / N + the variances
_TWO = _PAIR + """
  , v AS (SELECT n.block_id, n.i, n.row_nr, CAST(n.row_nr % 2 AS DOUBLE) AS coding FROM nodes n)
  , k AS (SELECT w.*, CASE WHEN z1 IS NULL THEN d0 - o * o / d1 ELSE d0 END AS a0, CASE WHEN z0 IS NULL THEN d1 - o * o / d0 ELSE d1 END AS a1, CASE WHEN z0 IS NULL OR z1 IS NULL THEN 0 ELSE o END AS oo FROM w WHERE z0 IS NOT NULL OR z1 IS NOT NULL)
  , f AS (SELECT k.*, (a0 * coalesce(z0, 0) + oo * coalesce(z1, 0)) / 32 AS p0, (a1 * coalesce(z1, 0) + oo * coalesce(z0, 0)) / 32 AS p1, x0.coding AS g0, x1.coding AS g1, {e0} AS e0, {e1} AS e1 FROM k JOIN v x0 ON x0.block_id = k.block_id AND x0.i = 0 JOIN v x1 ON x1.block_id = k.block_id AND x1.i = 1)
  , t AS (SELECT *, CASE WHEN z0 IS NULL THEN 1 ELSE a0 / 1024 + ln(1 + exp(e0)) / 1000 END AS m0, CASE WHEN z1 IS NULL THEN 1 ELSE a1 / 1024 + ln(1 + exp(e1)) / 1000 END AS m1, oo / 1024 AS mo FROM f)
  , u AS (SELECT *, m0 * m1 - mo * mo AS det_m FROM t)
  , y AS (SELECT *, CAST(z0 IS NOT NULL AS INT) AS h0, CAST(z1 IS NOT NULL AS INT) AS h1, m1 / det_m AS i0, m0 / det_m AS i1, -mo / det_m AS io FROM u)
  , c AS (SELECT *, h0 * (i0 * p0 + io * p1) AS b0, h1 * (i1 * p1 + io * p0) AS b1, h0 / (1 + exp(-e0)) / 1000 AS s0, h1 / (1 + exp(-e1)) / 1000 AS s1 FROM y) """
_LL = "-0.5 * ((h0 + h1) * ln(2 * pi()) + ln(det_m) + CASE WHEN h0 = 1 THEN p0 * b0 ELSE 0 END + CASE WHEN h1 = 1 THEN p1 * b1 ELSE 0 END)"


def _slope(a: str) -> str:
    return f"-0.5 * (h0 * (i0 - b0 * b0) * s0 * {a.format(0)} + h1 * (i1 - b1 * b1) * s1 * {a.format(1)})"


def _curve(a: str, b: str) -> str:
    x = [f"({a.format(k)}) * s{k} * b{k}" for k in (0, 1)]
    y = [f"({b.format(k)}) * s{k} * b{k}" for k in (0, 1)]
    return f"-0.5 * ({x[0]} * {y[0]} * i0 + {x[1]} * {y[1]} * i1 + ({x[0]} * {y[1]} + {x[1]} * {y[0]}) * io)"


@query("r3_reml_terms_pairs", _TWO.format(e0="0.5 - 0.25 * x0.coding", e1="0.5 - 0.25 * x1.coding") + f"SELECT block_id, round({_LL}, 6) + 0.0 AS ll, round({_slope('1')}, 6) + 0.0 AS g0, round({_slope('g{}')}, 6) + 0.0 AS g1, round({_curve('1', '1')}, 6) + 0.0 AS h00, round({_curve('1', 'g{}')}, 6) + 0.0 AS h01, round({_curve('g{}', 'g{}')}, 6) + 0.0 AS h11 FROM c")
def _(spark, d):
    m, info, stats, catalog = _pair_tables(spark, d)
    rows = workflows.prepare_reml_inputs(m, info, stats, _pair_annotations(stats), ["base", "coding"], catalog)
    g, h = F.col("gradient"), F.col("hessian")
    cells = {"ll": F.col("ll"), "g0": g[0], "g1": g[1], "h00": h[0], "h01": h[1], "h11": h[3]}
    return precision.reml_terms(m, rows, ["base", "coding"], [0.5, -0.25], 1e3).select("block_id", *[(F.round(x, 6) + 0.0).alias(n) for n, x in cells.items()])


@query("r5_reml_first_step", _TWO.format(e0="0", e1="0") + f""", b AS (SELECT ntile(10) OVER (ORDER BY k.chromStart) AS jk, c.block_id, {_slope('1')} AS g, {_curve('1', '1')} AS h FROM pair_blocks k SEMI JOIN q USING (block_id) LEFT JOIN c USING (block_id))
  , a AS (SELECT sum(g) AS g, sum(h) AS h FROM b), theta AS (SELECT -g / (h + 0.001 * (h - power(2, -52))) AS x FROM a)
  , jack AS (SELECT jk, any_value(theta.x) + (any_value(a.g) - coalesce(sum(b.g), 0)) / (any_value(a.h) - coalesce(sum(b.h), 0) + 1e-12) AS x FROM b, a, theta GROUP BY 1)
  , rows AS (SELECT count(*) AS n FROM m SEMI JOIN q USING (block_id))
  SELECT 'base' AS name, round(max(theta.x), 7) AS parameter, round(ln(1 + exp(max(theta.x))) / 1000 * max(rows.n), 7) AS heritability, round(sqrt(9 * var_samp(jack.x)), 6) AS parameter_SE FROM jack, theta, rows""")
def _(spark, d):
    m, info, stats, catalog = _pair_tables(spark, d)
    rows = workflows.prepare_reml_inputs(m, info, stats, _pair_annotations(stats), ["base", "coding"], catalog)
    fit = workflows.reml_fit(m, rows, ["base"], iterations=1, denominator=1e3, groups=10, blocks=workflows.block_order(catalog))
    return workflows.reml_results(spark, fit).select("name", F.round("parameter", 7).alias("parameter"), F.round("heritability", 7).alias("heritability"), F.round("parameter_SE", 6).alias("parameter_SE"))
