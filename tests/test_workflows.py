"""Workflows and graphs against stated examples, dense algebra and finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions import kernels
from blockweave.operators import graphs, precision, workflows
from blockweave.sources import stores

INFO = "block_id string, row_nr long, index int, site_ids string, position long, anc_alleles string, deriv_alleles string"
STATS = "row_nr long, CHR int, POS long, SNP string, REF string, ALT string, Z double"


@pytest.fixture(scope="module")
def toy(spark):
    """fixed: the published three-node example"""
    edges = spark.createDataFrame([("t", 0, 0, 2.0), ("t", 1, 1, 3.0), ("t", 2, 2, 4.0), ("t", 0, 1, 0.1), ("t", 1, 2, 0.2)], "block_id string, i int, j int, value double")
    info = spark.createDataFrame([("t", i, i, f"rs{i + 1}", 10 * i + 10, a, d) for i, (a, d) in enumerate(("AG", "CT", "TC"))], INFO)
    stats = spark.createDataFrame([(i, 1, 10 * i + 10, f"rs{i + 1}", a, d, z) for i, (a, d, z) in enumerate((("A", "G", 2.1), ("C", "T", -1.2), ("T", "C", 1.5), ("C", "G", 0.3)))], STATS)
    return precision.sparse_precision(edges), info, stats


def test_toy_weights_and_clumps(toy):
    m, info, stats = toy
    weights = [r.weight for r in workflows.run_blup(m, info, stats, 0.5, 1000).orderBy("row_nr").collect()]
    assert np.allclose(weights, [0.12852627, -0.09722901, 0.18074016, 0], atol=1e-8)
    flags = [r.is_index for r in workflows.run_clump(m, info, stats, 0.05, 1.0).orderBy("row_nr").collect()]
    assert flags == [True, True, True, False]


def test_toy_algebra(spark, toy):
    m = toy[0]
    whole = spark.createDataFrame([("t", i, i) for i in range(3)], "block_id string, i int, ord int")
    view = precision.select_nodes(whole, spark.createDataFrame([("t", 0, 0), ("t", 2, 1), ("t", 0, 5)], "block_id string, at int, ord int"))
    got = {(r.i, r.j): round(r.value, 9) for r in precision.selected_matrix(m, view).collect()}
    assert got == {(0, 0): 1.996666667, (0, 1): -0.006666667, (1, 0): -0.006666667, (1, 1): 3.986666667}
    update = spark.createDataFrame([("t", 0, 0.5)], "block_id string, i int, x double")
    y = precision.selected_multiply(precision.update_diagonal(m, update), view.withColumn("x", F.lit(1.0))).orderBy("ord").collect()
    assert np.allclose([r.y for r in y], [2.49, 3.98])
    x = spark.createDataFrame([("t", 10, 0, 1.0), ("t", 11, 0, 2.0), ("t", 12, 1, 3.0), ("t", 13, 2, 4.0)], "block_id string, variant int, i int, x double")
    assert np.allclose([r.y for r in precision.variant_solve(m, x).orderBy("variant").collect()], [1.4556114, 1.4556114, 0.8877722, 0.9556114])
    assert abs(precision.log_determinant(m).first().logdet - 3.173041) < 1e-6


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(1)
    entries, rows = [], []
    for b in range(6):
        for i in range(8):
            entries.append((f"b{b}", i, i, 3.0))
            entries.append((f"b{b}", i, min(i + 1 + b % 2, 7), float(rng.uniform(-0.6, 0.6))) if i < 7 - b % 2 else (f"b{b}", i, i, 0.5))
            rows.append((f"b{b}", b * 10 + i, i, float(rng.normal() * 2), 1000.0, 1.0, float(rng.integers(0, 2))))
    m = precision.sparse_precision(spark.createDataFrame(entries, "block_id string, i int, j int, value double"))
    return m, spark.createDataFrame(rows, "block_id string, row_nr long, i int, z double, n double, base double, coding double")


def total(m, rows, theta):
    t = precision.reml_terms(m, rows, ["base", "coding"], list(theta), 10.0).collect()
    return sum(r.ll for r in t), np.sum([r.gradient for r in t], 0)


def test_reml_gradient_by_finite_differences(blocks):
    m, rows = blocks
    theta, h = np.array([0.3, -0.2]), 1e-5
    got = total(m, rows, theta)[1]
    for k in range(2):
        step = h * np.eye(2)[k]
        assert abs((total(m, rows, theta + step)[0] - total(m, rows, theta - step)[0]) / (2 * h) - got[k]) < 1e-5 * max(1, abs(got[k]))


def test_reml_fit_reaches_a_maximum(spark, blocks, tmp_path):
    m, rows = blocks
    fit = workflows.reml_fit(m, rows, ["base", "coding"], iterations=60, denominator=10.0, tolerance=1e-6, groups=3)
    assert fit.converged and np.abs(total(m, rows, fit.parameters)[1]).max() < 0.05
    assert fit.jackknife["parameters"].shape == (3, 2) and fit.enrichment[0] == pytest.approx(1)
    from blockweave.sources import stores

    path = str(tmp_path / "fit.csv")
    stores.write_reml_results(spark, path, fit, "wide", "a")
    stores.write_reml_results(spark, path, fit, "wide", "b", append=True)
    with pytest.raises(FileExistsError):
        stores.write_reml_results(spark, path, fit, "wide", "c")
    lines = open(path).read().splitlines()
    assert len(lines) == 3 and lines[0].startswith("name,base,base_SE,base_log10pval,coding")
    assert workflows.reml_results(spark, fit).count() == 2 and workflows.convergence_results(spark, fit)[1].count() == len(fit.log)
    scores = workflows.variant_scores(m, rows, fit, rows.select("row_nr").union(spark.createDataFrame([(999,)], "row_nr long")), 10.0)
    assert scores.count() == rows.count() + 1 and scores.where("row_nr = 999").first().gradient == 0
    left = workflows.project_out(rows, "z", ["base", "coding"]).agg(F.sum("z"), F.sum(F.col("z") * F.col("coding"))).first()
    assert abs(left[0]) < 1e-8 and abs(left[1]) < 1e-8


def test_partial_likelihood_gradients():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    p, seen, n = a @ a.T + 6 * np.eye(6), np.array([0, 2, 3]), 50.0
    pz, s = rng.normal(size=3), rng.uniform(0.1, 0.5, 6)
    ll, by_node, by_intercept = kernels.partial_likelihood(p, pz, s, seen, n, 1.2)
    h = 1e-6
    for k in range(6):
        d = h * np.eye(6)[k]
        assert abs((kernels.partial_likelihood(p, pz, s + d, seen, n, 1.2)[0] - kernels.partial_likelihood(p, pz, s - d, seen, n, 1.2)[0]) / (2 * h) - by_node[k]) < 1e-5
    assert abs((kernels.partial_likelihood(p, pz, s, seen, n, 1.2 + h)[0] - kernels.partial_likelihood(p, pz, s, seen, n, 1.2 - h)[0]) / (2 * h) - by_intercept) < 1e-5
    assert kernels.partial_likelihood(p, pz, s, seen, n, -0.1)[0] == -np.inf and np.isfinite(ll)


def test_lasso_reaches_the_inverse():
    p = np.diag([2.0, 3.0, 2.5]) + np.array([[0, 0.4, 0], [0.4, 0, -0.3], [0, -0.3, 0]])
    c = np.linalg.inv(p)
    assert np.allclose(kernels.lasso_precision(c, np.abs(p) > 0, sweeps=500), p, atol=1e-6)
    assert (kernels.lasso_precision(c, np.ones((3, 3), bool), penalty=10.0) == np.diag(np.diag(kernels.lasso_precision(c, np.ones((3, 3), bool), penalty=10.0)))).all()


def test_simulation_has_its_heritability(blocks):
    m, rows = blocks
    v = rows.select("block_id", "row_nr", "i", F.lit(0.3).alias("af"))
    out = workflows.simulate(m, v, 1000.0, 0.4, [0.8], [1.0], alpha=-1.0, seed=5)
    first, again = out.orderBy("row_nr").collect(), workflows.simulate(m, v.repartition(7), 1000.0, 0.4, [0.8], [1.0], alpha=-1.0, seed=5).orderBy("row_nr").collect()
    assert abs(sum(r.beta * r.alpha for r in first) - 0.4) < 1e-9 and np.allclose([r.z for r in first], [r.z for r in again])


def test_several_populations_with_one_equal_single_weights(spark, blocks):
    m, rows = blocks
    one = workflows.multi_population_blup(m.withColumn("population", F.lit(0)), rows.select("block_id", F.lit(0).alias("population"), "i", "z"), np.array([[0.02]]), [1000.0])
    want = precision.blup(m, rows.withColumn("is_representative", F.lit(True)), 0.02).join(rows.select("row_nr", "i"), "row_nr")
    both = one.withColumnRenamed("weight", "w").join(want, ["block_id", "i"]).collect()
    assert len(both) == rows.count() and np.allclose([r.w for r in both], [r.weight for r in both])


# ---- graphs; fixed: the numbers of stated examples


def test_brick_haplotype_example(spark):
    bricks = spark.createDataFrame([(0, 1, 0.5)], "brick int, child int, frequency double")
    none = spark.createDataFrame([], "event int, focal_brick int, parent_brick int, child_bricks array<int>, sibling_bricks array<int>")
    labelled = spark.createDataFrame([(0,)], "brick int")
    g = graphs.brick_haplotype_graph(bricks, none, labelled)
    assert sorted(tuple(r) for r in g.collect()) == [(2, 15, 0.0), (3, 15, 0.0), (4, 14, 0.0)]
    assert graphs.make_graph(bricks, none, spark.createDataFrame([(0, 0, 0)], "group int, brick int, mutation int"), 10.0).count() == 0


def test_reduction_examples(spark):
    names = spark.createDataFrame([(0, 0), (1, 1)], "brick int, mutation int")
    edge = lambda *rows: spark.createDataFrame(list(rows), "`from` int, `to` int, weight double")
    assert sorted(tuple(r) for r in graphs.reduce_graph(edge((4, 8, 0.7), (4, 30, 0.5)), names, 1.0).collect()) == [(0, -4, 0.5), (0, 1, 0.7), (1, 0, 0.7)]
    assert graphs.reduce_graph(edge((4, 8, 0.7), (4, 9, 0.1), (4, 30, 1.5)), names, 1.0).count() == 0
    with pytest.raises(Exception, match="negative"):
        graphs.reduce_graph(edge((4, 8, -0.1)), names, 1.0).collect()


def test_finalising_equals_removing_one_by_one(spark):
    rng = np.random.default_rng(6)
    nodes = [0, 1, 2, 3, -1, -2, -3]
    edges = {(int(a), int(b)): float(rng.integers(1, 16)) / 8 for a in nodes for b in nodes if a != b and rng.random() < 0.4}
    one = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "`from` int, `to` int, weight double")
    groups = spark.createDataFrame([(k, k) for k in range(4)], "group int, mutation int")
    got = {(r["from"], r["to"]): r.weight for r in graphs.finalise_graph(one, one, groups, 2.0).collect()}
    now = dict(edges)
    for (a, b), w in edges.items():
        now.setdefault((b, a), w)
    now |= {(b, a): w for (a, b), w in sorted(edges.items()) if (b, a) not in edges}
    now |= edges
    for gone in (-3, -2, -1):
        for a in nodes:
            for b in nodes:
                if a != b and (a, gone) in now and (gone, b) in now and gone not in (a, b):
                    w = min(now[a, gone] + now[gone, b], now.get((a, b), np.inf))
                    if w <= 2.0:
                        now[a, b] = w
        now = {e: w for e, w in now.items() if gone not in e}
    want = {}
    for (a, b), w in now.items():
        want[min(a, b), max(a, b)] = min(w, want.get((min(a, b), max(a, b)), np.inf))
    assert got == want


def test_brick_examples(spark):
    initial = spark.createDataFrame([(0.0, 1.0, 2, 0), (0.0, 2.0, 4, 3)], "left double, right double, parent int, child int")
    out = spark.createDataFrame([(1, 0)], "transition int, child int")
    come = spark.createDataFrame([(1, 1.0, 2.0, 3, 0)], "transition int, left double, right double, parent int, child int")
    state = spark.createDataFrame([(1, 0, 2, 3, 0.0, 1), (1, 2, -1, -1, 2.0, 0), (1, 3, -1, 4, 1.0, 1), (1, 4, -1, -1, 3.0, 0)], "transition int, node int, prev_parent int, curr_parent int, time double, curr_num_samples int")
    at = spark.createDataFrame([(1, 1.0)], "transition int, left double")
    trees = graphs.tree_rows("x", spark, initial, at, out, come, state, 2)
    got = [tuple(r) for r in graphs.brick_edges(trees).orderBy("brick").select("left", "right", "parent", "child").collect()]
    assert got == [(0.0, 1.0, 2, 0), (0.0, 1.0, 4, 3), (1.0, 2.0, 3, 0), (1.0, 2.0, 4, 3)]
    uncut = graphs.tree_rows("y", spark, initial, at.limit(0), out.limit(0), come.limit(0), state.limit(0), 2)
    assert graphs.brick_edges(uncut).count() == 2
    two = spark.createDataFrame([("x", 0, 0.0, 1.0, 2, 0), ("x", 1, 0.0, 1.0, 2, 1)], "ts_id string, brick int, left double, right double, parent int, child int")
    bricks, events = graphs.brick_events(two, spark.createDataFrame([("x", 0), ("x", 1)], "ts_id string, node int"))
    assert sorted((r.brick, r.frequency) for r in bricks.collect()) == [(0, 0.5), (1, 0.5)]
    assert [(r.focal_brick, r.parent_brick, r.child_bricks, r.sibling_bricks) for r in events.orderBy("event").collect()] == [(0, None, [], [0, 1]), (1, None, [], [0, 1])]
    mutations = spark.createDataFrame([(1, 0.2, 1), (0, 0.1, 0)], "mutation int, position double, node int")
    assert [(r.group, r.brick, r.mutations) for r in graphs.mutation_groups(mutations, two).orderBy("group").collect()] == [(0, 0, [0]), (1, 1, [1])]
    with pytest.raises(Exception, match="not valid"):
        graphs.tree_rows("z", spark, initial.withColumn("right", F.lit(0.0)), at, out, come, state, 2).collect()


def test_graph_from_trees_and_command_line(spark, tmp_path):
    from blockweave.__main__ import main

    # samples 0, 1, 2 under 3 = (0, 1) and the root 4 = (3, 2)
    initial = spark.createDataFrame([(0.0, 1.0, 3, 0), (0.0, 1.0, 3, 1), (0.0, 1.0, 4, 2), (0.0, 1.0, 4, 3)], "left double, right double, parent int, child int")
    empty = {
        "transitions": "transition int, left double", "edges_out": "transition int, child int", "edges_in": "transition int, left double, right double, parent int, child int",
        "node_state": "transition int, node int, prev_parent int, curr_parent int, time double, curr_num_samples int",
    }
    tables = {"initial_edges": initial} | {n: spark.createDataFrame([], t) for n, t in empty.items()}
    tables["sample_nodes"] = spark.createDataFrame([(0,), (1,), (2,)], "node int")
    tables["mutations"] = spark.createDataFrame([(0, 0.1, 0), (1, 0.2, 3), (2, 0.3, 1)], "mutation int, position double, node int")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/tables/{name}")
    main(["reduce", f"{tmp_path}/tables", "100", f"{tmp_path}/out"])
    got = sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/out", schema="a int, b int, w double").collect())
    assert [(a, b) for a, b, _ in got] == [(0, 1), (0, 2), (1, 2)] or [(a, b) for a, b, _ in got] == [(0, 1), (1, 2)]
    assert all(w >= 0 for _, _, w in got)
    # the child is tied to its parent by the ratio of their odds: (1/3) and (2/3)
    assert dict(((a, b), w) for a, b, w in got)[0, 1] == pytest.approx(np.log(4), abs=1e-4)


def test_sites_and_brick_identities(spark):
    m = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "mutation int, site int")
    f = spark.createDataFrame([(0, 0.05), (1, 0.5), (2, 0.96)], "mutation int, frequency double")
    assert [r.mutation for r in graphs.prune_sites(m, f, 0.1).collect()] == [1]
    with pytest.raises(Exception, match="several mutations"):
        graphs.prune_sites(m.withColumn("site", F.lit(1)), f, 0.1).collect()
    e = spark.createDataFrame([(0, 1, 0.0, 1.0), (1, 1, 1.0, 2.0), (2, 1, 3.0, 4.0), (3, 1, 4.0, 5.0)], "brick int, child int, left double, right double")
    leaves = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [1, 2]), (3, [1])], "brick int, leaves array<int>")
    assert sorted(tuple(r) for r in graphs.brick_identities(e, leaves).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_partial_terms_through_spark(blocks):
    m, rows = blocks
    some = rows.select("block_id", "i", F.when(F.col("i") != 3, F.col("z")).alias("z"), F.lit(0.01).alias("sigma2"))
    got = precision.partial_terms(m, some, 1000.0).collect()
    assert len(got) == 6 and all(np.isfinite(r.ll) and len(r.gradient) == 8 for r in got)


def test_stream_of_statistics_meets_blocks(spark, tmp_path):
    from blockweave.streaming.partition import stream_blocks

    stats = spark.createDataFrame([(0, 1, 50, "rs0"), (1, 1, 250, "rs1"), (2, 2, 50, "rs2")], "row_nr long, CHR int, POS long, SNP string")
    stats.write.parquet(f"{tmp_path}/in")
    blocks_ = spark.createDataFrame([("a", 1, 0, 100), ("b", 1, 100, 300)], "block_id string, chrom int, chromStart long, chromEnd long")
    out = stream_blocks(spark, f"{tmp_path}/in", "row_nr long, CHR int, POS long, SNP string", blocks_)
    query = out.writeStream.format("memory").queryName("placed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.SNP, r.block_id) for r in spark.table("placed").collect()) == [("rs0", "a"), ("rs1", "b")]


def test_edge_lists_of_many_blocks_take_few_files(spark, tmp_path):
    matrix = spark.range(60_000).select(F.concat(F.lit("b,"), (F.col("id") % 20_000).cast("string")).alias("block_id"), F.lit(0).alias("i"), (F.col("id") / 20_000).cast("int").alias("j"), (F.col("id") / 8).alias("value"))
    stores.write_edgelist(matrix, f"{tmp_path}/many")
    files = list((tmp_path / "many").glob("*.csv"))
    assert len(files) <= 8 and not [f for f in (tmp_path / "many").iterdir() if f.is_dir()]
    back = spark.read.csv(f"{tmp_path}/many", schema="i int, j int, value double, block_id string")
    assert back.select(*matrix.columns).exceptAll(matrix).count() == 0 and back.count() == 60_000
    assert back.withColumn("file", F.input_file_name()).groupBy("block_id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    few = matrix.where("block_id in ('b,1', 'b,2')").repartition(4, "j")
    stores.write_edgelist(few, f"{tmp_path}/few", folders=True)
    assert len(list((tmp_path / "few").glob("block_id=*/*.csv"))) == 2
    assert spark.read.csv(f"{tmp_path}/few", schema="i int, j int, value double, block_id string").select(*matrix.columns).exceptAll(few).count() == 0


def test_reduced_graph_meets_only_bricks_that_may_be_met(spark):
    bricks = spark.createDataFrame([(k, 5000 + k, 0.5) for k in (7, 1200, 1500)], "brick int, child int, frequency double")
    events = spark.createDataFrame([(0, 7, None, [1200], []), (1, 1200, 7, [1500], []), (2, 1500, 1200, [], [])], "event int, focal_brick int, parent_brick int, child_bricks array<int>, sibling_bricks array<int>")
    names = bricks.select("brick", F.col("brick").alias("mutation"))
    graph = graphs.brick_haplotype_graph(bricks, events, names, 3.0, True)
    pairs = lambda df: {(r["from"], r["to"]) for r in df.where("`to` >= 0").collect()}
    assert pairs(graphs.reduce_graph(graph, names, 1.0)) == {(7, 1200), (1200, 7), (1200, 1500), (1500, 1200)}
    some = graphs.reduce_graph(graph, names, 1.0, names.where("brick < 1000"))
    assert pairs(some) == {(7, 1200), (1200, 7)}
    assert {r["from"] for r in some.where("`to` < 0").collect()} == {7, 1200, 1500}
