"""What many blocks cost before their kernels run: tables are read and worked out once, and no task numbers all blocks."""

import re

import pytest
from pyspark.sql import functions as F

from blockweave.operators import precision, workflows
from blockweave.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(spark, df):
    """``df``, and a counter of the rows that are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def scans(spark, name):
    return plan(registry.QUERIES[name](spark, SF)).count("FileScan parquet")


# ---- F10 r5_reml_first_step


def small_blocks(spark, n=12):
    nodes = spark.range(2 * n).select(F.format_string("b%02d", F.expr("id div 2")).alias("block_id"), F.col("id").alias("row_nr"), (F.col("id") % 2).cast("int").alias("i"))
    matrix = nodes.select("block_id", "i", F.col("i").alias("j"), F.lit(2.0).alias("value"))
    return matrix, nodes.withColumns({"z": (F.col("row_nr") % 7 - 3) / 2, "n": F.lit(100.0), "base": F.lit(1.0)})


def test_blocks_are_numbered_and_grouped_without_a_task_that_sees_them_all(spark):
    catalog = spark.createDataFrame([(f"b{k}", f"chr{1 + k % 3}", k * 10 % 70, k * 10 % 70 + 5) for k in range(23)], "block_id string, chrom string, chromStart long, chromEnd long")
    order = workflows.block_order(catalog)
    want = sorted(catalog.collect(), key=lambda r: (int(r.chrom[3:]), r.chromStart, r.chromEnd, r.block_id))
    assert {r.block_id: r.block_nr for r in order.collect()} == {r.block_id: k for k, r in enumerate(want)}
    for groups in (1, 4, 7, 23, 30):
        found = workflows.jackknife_groups_of(order.withColumn("block_nr", F.col("block_nr") * 3 + 5), groups)
        n = min(groups, 23)
        dealt = [k for k in range(n) for _ in range(23 // n + (k < 23 % n))]
        assert {r.block_id: r.jackknife_group for r in found.collect()} == {r.block_id: g for r, g in zip(want, dealt)}
        assert dict(found.dtypes)["jackknife_group"] == "int"
        for made in (order, found):
            over = re.findall(r"(?:row_number|ntile)\([^)]*\) windowspecdefinition\((\w+)", plan(made))
            assert over and set(over) == {"_part"}
    assert workflows.jackknife_groups_of(order.limit(0), 5).count() == 0


def test_a_fit_works_its_rows_out_once(spark):
    matrix, rows = small_blocks(spark)
    rows, seen = counted(spark, rows)
    workflows.reml_fit(matrix, rows, ["base"], iterations=1, denominator=10.0, groups=3)
    assert seen.value == 24


def test_edges_are_read_once_and_both_directions_are_one_sum(spark):
    edges = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 1, 0, 0.25), ("a", 0, 1, 0.5), ("a", 1, 1, 3.0), ("b", 2, 1, 0.1), ("b", 1, 2, 0.2), ("b", 2, 1, 0.3)], "block_id string, i int, j int, value double")
    once, seen = counted(spark, edges)
    found = {(r.block_id, r.i, r.j): r.value for r in precision.sparse_precision(once).collect()}
    assert seen.value == 7 and precision.sparse_precision(edges).columns == ["block_id", "i", "j", "value"]
    assert {k: v for k, v in found.items() if k[0] == "a"} == {("a", 0, 0): 2.0, ("a", 0, 1): 0.75, ("a", 1, 0): 0.75, ("a", 1, 1): 3.0}
    assert found["b", 1, 2] == found["b", 2, 1] == pytest.approx(0.6) and len(found) == 6
    assert {(r.i, r.j): r.value for r in precision.sparse_precision(edges.where("block_id = 'a'"), symmetric=False).collect()} == {(0, 0): 2.0, (1, 0): 0.25, (0, 1): 0.5, (1, 1): 3.0}


# ---- F23 r3_reml_terms


def test_terms_work_their_rows_out_once(spark):
    matrix, rows = small_blocks(spark)
    want = {r.block_id: r.ll for r in precision.reml_terms(matrix, rows, ["base"], [0.1], 10.0).collect()}
    rows, seen = counted(spark, rows)
    found = precision.reml_terms(matrix, rows, ["base"], [0.1], 10.0)
    assert {r.block_id: r.ll for r in found.collect()} == want and seen.value == 24


# ---- F11 c1_run_clump


def test_c1_run_clump_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "c1_run_clump") <= 11


# ---- F15 b2_run_blup


def test_b2_run_blup_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "b2_run_blup") <= 11


# ---- F16 q1_impute


def test_q1_impute_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "q1_impute") <= 6


# ---- F17 l8_variant_solve


def test_l8_variant_solve_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "l8_variant_solve") <= 11


# ---- F18 s23_normalise


def test_s23_normalise_reads_its_tables_and_takes_inverses_once(spark):
    made = plan(registry.QUERIES["s23_normalise"](spark, SF))
    assert made.count("FileScan parquet") <= 3 and made.count("MapInArrow") == 1


def test_normalised_blocks_have_inverses_with_ones(spark):
    matrix = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 1, 0.5), ("a", 1, 0, 0.5), ("a", 1, 1, 3.0), ("b", 0, 0, 4.0), ("c", 0, 0, 1.0), ("c", 1, 1, 2.0), ("c", 0, 1, 0.0), ("c", 1, 0, 0.0)], "block_id string, i int, j int, value double")
    found = precision.normalise(matrix)
    values = {(r.block_id, r.i, r.j): r.value for r in found.collect()}
    assert found.columns == matrix.columns and len(values) == 9 and values["a", 0, 1] == pytest.approx(0.5 * (6 / 5.75**2) ** 0.5) and values["c", 0, 1] == 0
    assert [r.y for r in precision.inverse_diagonal(found).collect()] == pytest.approx([1.0] * 5)


# ---- F19 l7_selected_log_determinant


def test_l7_selected_log_determinant_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "l7_selected_log_determinant") <= 6


# ---- F20 q4_project_weights


def test_q4_project_weights_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "q4_project_weights") <= 9


# ---- F21 e1_estimate_precision


def test_e1_estimate_precision_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "e1_estimate_precision") <= 3


# ---- F24 q2_outlier_chi2


def test_q2_outlier_chi2_reads_its_tables_once_for_each_use(spark):
    assert scans(spark, "q2_outlier_chi2") <= 6


# ---- F22 m1_simulate


def test_matrices_of_pairs_are_read_once(spark):
    assert plan(registry._whole_pairs(spark, SF)).count("FileScan parquet") <= 3
