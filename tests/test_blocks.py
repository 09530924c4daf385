"""Queries over whole blocks against their DuckDB equivalents and against dense algebra."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.operators import precision, workflows
from blockweave.plans import blocks, registry, trees  # noqa: F401

SF = "/root/testdata/sf0.001"
OWN = ["l3_solve_blocks", "l9_inverse_diagonal_blocks", "b2_blup_blocks", "q4_accuracy_blocks", "q3_regularise_blocks", "r3_reml_terms_pairs", "r5_reml_first_step", "g1_brick_edges", "a16_brick_shares", "g2_brick_events", "e2_correlation_edgelist"]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    as_rows = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy()))
    assert as_rows(got) == as_rows(want)


@pytest.fixture(scope="module")
def dense(spark):
    """block_id -> (P, rows in order of their node)."""
    out = {}
    rows = blocks.tri_rows(spark, SF).toPandas().sort_values(["block_id", "i"])
    m = blocks.tri_matrix(spark, SF).toPandas()
    for b, r in rows.groupby("block_id"):
        p = np.zeros((len(r), len(r)))
        e = m[m.block_id == b]
        p[e.i, e.j] = e.value
        out[b] = p, r
    return out


def by_block(df, value):
    got = {}
    for r in df.collect():
        got.setdefault(r.block_id, {})[r.row_nr] = r[value]
    return got


def test_sizes_differ_and_entries_lie_off_the_diagonal(dense):
    sizes = sorted(len(p) for p, _ in dense.values())
    assert sizes[0] < 5 and sizes[-1] > 25 and all(np.count_nonzero(p) > len(p) for p, _ in dense.values() if len(p) > 3)


def test_log_determinants(spark, dense):
    got = {r.block_id: r.logdet for r in registry.QUERIES["l7_log_determinant_blocks"](spark, SF).collect()}
    assert got.keys() == dense.keys() and all(np.isclose(got[b], np.linalg.slogdet(p)[1], rtol=0, atol=1e-8) for b, (p, _) in dense.items())


def test_clumps(spark, dense):
    got, n = by_block(registry.QUERIES["c1_clump_blocks"](spark, SF), "is_index"), 0
    for b, (p, r) in dense.items():
        z, cor, lead, pruned = r.z.to_numpy(), np.linalg.inv(p), set(), set()
        for k in sorted(range(len(z)), key=lambda k: (-(z[k] ** 2), k)):
            if k not in pruned and z[k] ** 2 >= 4.0:
                lead.add(k)
                pruned |= set(np.flatnonzero(cor[k] ** 2 >= 1e-5).tolist())
        n += len(pruned) - len(lead)
        assert {q for q, flag in got[b].items() if flag} == {r.row_nr.iloc[k] for k in lead}
    assert n > 20  # pruned without leading


def test_imputation_and_outliers(spark, dense):
    z_hat, chi2 = by_block(registry.QUERIES["q1_impute_blocks"](spark, SF), "z"), by_block(registry.QUERIES["q2_outlier_chi2_blocks"](spark, SF), "chi2")
    for b, (p, r) in dense.items():
        cor, z, i = np.linalg.inv(p), r.z.to_numpy(), r.i.to_numpy()
        seen = i % 3 != 1
        want = z.copy()
        want[~seen] = cor[np.ix_(~seen, seen)] @ np.linalg.solve(cor[np.ix_(seen, seen)], z[seen])
        assert np.allclose([z_hat[b][q] for q in r.row_nr], want, atol=1e-8)
        for own in (i % 2 == 0, i % 2 == 1):
            if own.any():
                w = np.linalg.solve(cor[np.ix_(~own, ~own)], cor[np.ix_(~own, own)]) if (~own).any() else np.zeros((0, own.sum()))
                spread = np.diag(cor)[own] - (w * cor[np.ix_(~own, own)]).sum(0)
                assert np.allclose([chi2[b][q] for q in r.row_nr[own]], (z[own] - w.T @ z[~own]) ** 2 / spread, atol=1e-8)


def test_view_matrices(spark, dense):
    got = {}
    for r in registry.QUERIES["l4_selected_matrix_blocks"](spark, SF).collect():
        got.setdefault(r.block_id, {})[r.i, r.j] = r.value
    for b, (p, _) in dense.items():
        keep = np.flatnonzero(np.arange(len(p)) % 3 != 1)
        want = np.linalg.inv(np.linalg.inv(p)[np.ix_(keep, keep)])
        full = np.zeros_like(want)
        for (i, j), v in got[b].items():
            full[i, j] = v
        assert np.allclose(full, want, atol=1e-8)


# ---- REML


def reml_tables(spark, order):
    """Blocks whose names sort otherwise than their catalog; one of them has no rows, and one row belongs to no block's list."""
    rng = np.random.default_rng(4)
    entries, rows, catalog = [], [], []
    for nr, b in enumerate(order):
        catalog.append((b, 1, nr * 100, nr * 100 + 100))
        for i in range(6):
            entries += [(b, i, i, 3.0), (b, i, (i + 1) % 6, 0.3)]
            if b != "empty":
                rows.append((b, nr * 10 + i, i, float(rng.normal() * 2), 1000.0, 1.0, float(rng.integers(0, 2))))
    m = precision.sparse_precision(spark.createDataFrame(entries, "block_id string, i int, j int, value double"))
    return m, spark.createDataFrame(rows, "block_id string, row_nr long, i int, z double, n double, base double, coding double"), spark.createDataFrame(catalog, "block_id string, chrom int, chromStart long, chromEnd long")


def test_groups_follow_the_catalog_and_empty_blocks_stay(spark):
    plain = [f"p{k}" for k in range(11)]
    padded = [f"p{k:02d}" for k in range(11)]
    fits = []
    for order in (plain, padded):
        m, rows, catalog = reml_tables(spark, order)
        fits += [workflows.reml_fit(m, rows, ["base", "coding"], iterations=3, denominator=10.0, groups=4, blocks=b) for b in (None, workflows.block_order(catalog))]
    for fit in fits:
        assert np.allclose(fit.jackknife["parameters"], fits[0].jackknife["parameters"]) and fit.groups == 4
    m, rows, catalog = reml_tables(spark, ["a", "empty", "b", "c"])
    got = workflows.reml_fit(m, rows, ["base", "coding"], iterations=2, denominator=10.0, groups=4, blocks=workflows.block_order(catalog))
    without = workflows.reml_fit(m, rows, ["base", "coding"], iterations=2, denominator=10.0, groups=4)
    assert got.groups == 4 and without.groups == 3 and np.allclose(got.parameters, without.parameters) and np.isfinite(got.jackknife["parameters"]).all()
    scores = workflows.variant_scores(m, rows, got, rows.select("row_nr"), 10.0, blocks=workflows.block_order(catalog)).join(rows, "row_nr")
    assert {(r.block_id, r.jackknife_group) for r in scores.collect()} == {("a", 0), ("b", 2), ("c", 3)}


def test_a_singular_group_is_nan_and_leaves_the_others():
    g, h = np.array([[1.0], [2.0], [3.0]]), np.array([[[-2.0 - 1e-12]], [[1.0]], [[1.0 + 1e-12]]])
    out = workflows.leave_one_out_parameters(g, h, np.array([0.5]))
    assert np.isfinite(out[1:]).all()
    singular = workflows.leave_one_out_parameters(np.ones((2, 2)), np.stack([np.full((2, 2), -1e30), np.full((2, 2), -2e30)]), np.zeros(2))
    assert np.isnan(singular).all()


def test_variant_hessians_and_heritability(spark):
    m, rows, catalog = reml_tables(spark, ["a", "b"])
    fit = workflows.reml_fit(m, rows, ["base", "coding"], iterations=4, denominator=10.0, groups=2)
    got = {r.row_nr: r for r in workflows.variant_scores(m, rows, fit, rows.select("row_nr").union(spark.createDataFrame([(999,)], "row_nr long")), 10.0).collect()}
    assert got[999].hessian == 0 and got[999].h2 == 0 and got[999].jackknife_group is None
    entries, data = m.toPandas(), rows.toPandas()
    for b in ("a", "b"):
        v = data[data.block_id == b].sort_values("i")
        e = entries[entries.block_id == b]
        p = np.zeros((6, 6))
        p[e.i, e.j] = e.value
        eta = v[["base", "coding"]].to_numpy() @ fit.parameters
        s = 1 / (1 + np.exp(-eta))
        inverse = np.linalg.inv(p / 1000 + np.diag(np.log1p(np.exp(eta)) / 10))
        beta = inverse @ (p @ v.z.to_numpy() / np.sqrt(1000))
        gradient, hessian = -0.5 * (np.diag(inverse) - beta**2), -0.5 * np.diag(inverse) * beta**2
        assert np.allclose([got[k].gradient for k in v.row_nr], gradient * s / 10) and np.allclose([got[k].h2 for k in v.row_nr], np.log1p(np.exp(eta)) / 10)
        assert np.allclose([got[k].hessian for k in v.row_nr], hessian * (s / 10) ** 2 + gradient * s * (1 - s) / 10)


def test_evaluations_map_over_kept_blocks(spark):
    m, rows, _ = reml_tables(spark, ["a", "b", "c"])
    state = precision.reml_state(m, rows, ["base", "coding"], 1000.0).persist()
    state.count()
    sums = precision.reml_sums(state, [0.1, 0.2], 1000.0, 10.0, 1.0)
    plan = sums._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in plan and "MapInArrow" in plan
    exact = {r.block_id: r.gradient for r in sums.collect()}
    near = precision.reml_sums(state, [0.1, 0.2], 1000.0, 10.0, 1.0, "xdiag", 6, 3)
    assert all(np.allclose(exact[r.block_id], r.gradient) for r in near.collect())  # as many probes as nodes
    again = {r.block_id: r.gradient for r in precision.reml_sums(state, [0.1, 0.2], 1000.0, 10.0, 1.0, "hutchinson", 4, 3).collect()}
    assert again == {r.block_id: r.gradient for r in precision.reml_sums(state, [0.1, 0.2], 1000.0, 10.0, 1.0, "hutchinson", 4, 3).collect()}
    state.unpersist()


def test_fit_with_estimated_derivatives(spark):
    m, rows, _ = reml_tables(spark, ["a", "b", "c", "d"])
    exact = workflows.reml_fit(m, rows, ["base"], iterations=8, denominator=10.0, groups=2)
    near = workflows.reml_fit(m, rows, ["base"], iterations=8, denominator=10.0, groups=2, method="xdiag", n_samples=5, seed=1)
    assert np.allclose(exact.parameters, near.parameters, atol=0.15)


def test_weights_by_allele_of_one_population(spark):
    m, rows, _ = reml_tables(spark, ["a", "b"])
    af = rows.select("block_id", F.lit(0).alias("population"), "i", "z", F.when(F.col("i") % 2 == 0, 0.5).otherwise(0.1).alias("af"))
    one = m.withColumn("population", F.lit(0))
    flat = workflows.multi_population_blup(one, af, np.array([[0.02]]), [1000.0])
    same = {(r.block_id, r.i): r for r in workflows.multi_population_blup(one, af, np.array([[0.02]]), [1000.0], alpha=-1.0).collect()}
    for r in flat.collect():  # alpha -1: effects by standard deviation have one variance
        got = same[r.block_id, r.i]
        assert np.isclose(got.weight, r.weight) and np.isclose(got.per_allele, r.weight / np.sqrt(0.5 if r.i % 2 == 0 else 0.18))
    p = np.zeros((6, 6))
    e = m.where("block_id = 'a'").toPandas()
    p[e.i, e.j] = e.value
    v = rows.where("block_id = 'a'").toPandas().sort_values("i")
    het = np.where(v.i % 2 == 0, 0.5, 0.18)
    s = np.diag(0.02 * het)  # alpha 0: one variance by allele
    want = s @ np.linalg.solve(s + p / 1000, p @ v.z.to_numpy() / np.sqrt(1000))
    got = workflows.multi_population_blup(one, af, np.array([[0.02]]), [1000.0], alpha=0.0).where("block_id = 'a'").orderBy("i").collect()
    assert np.allclose([r.weight for r in got], want) and np.allclose([r.per_allele for r in got], want / np.sqrt(het))


# ---- simulation of populations


def population_tables(spark, blocks_=12, nodes=50):
    entries, variants = [], []
    for b in range(blocks_):
        for i in range(nodes):
            for k in (0, 1):
                if not (k == 1 and i == 7):  # the second population lacks a node
                    entries.append((f"b{b}", k, i, i, 1.2))
                    j = i + 1
                    if j < nodes and not (k == 1 and 7 in (i, j)):
                        entries += [(f"b{b}", k, i, j, 0.3), (f"b{b}", k, j, i, 0.3)]
            variants += [(f"b{b}", b * 1000 + 2 * i + c, i, [0.1 + 0.008 * i, 0.5], float(i % 2)) for c in (0, 1)]
    return spark.createDataFrame(entries, "block_id string, population int, i int, j int, value double"), spark.createDataFrame(variants, "block_id string, row_nr long, i int, af array<double>, coding double")


def test_several_populations_are_simulated(spark):
    m, v = population_tables(spark)
    h2 = np.array([[0.4, 0.21], [0.21, 0.3]])
    out = workflows.simulate_populations(m, v, [1000.0, 4000.0], h2, [0.5], alpha=-1.0, seed=2)
    rows = out.toPandas()
    one, two = rows[rows.population == 0], rows[rows.population == 1]
    assert len(one) == 1200 and len(two) == 1200 - 24 and set(rows.n) == {1000.0, 4000.0}
    assert abs((one.beta_per_sd**2).sum() - 0.4) < 1e-9
    both = one.merge(two, on="row_nr")
    causal = both[both.beta_per_allele_x != 0]
    assert 0.42 < len(causal) / len(both) < 0.58 and ((both.beta_per_allele_x != 0) == (both.beta_per_allele_y != 0)).all()
    assert abs(np.corrcoef(causal.beta_per_allele_x, causal.beta_per_allele_y)[0, 1] - 0.21 / np.sqrt(0.12)) < 0.08
    assert np.allclose(rows.beta_per_sd, rows.beta_per_allele * np.sqrt(2 * rows.af * (1 - rows.af)))
    # marginal effects are R beta; noise has the covariance R
    p = np.diag(np.full(50, 1.2)) + 0.3 * (np.eye(50, k=1) + np.eye(50, k=-1))
    b0 = one[one.block_id == "b0"]
    sums = np.bincount(b0.i, b0.beta_per_sd, 50)
    assert np.allclose(b0.alpha, np.linalg.solve(p, sums)[b0.i])
    noise = (one.z - np.sqrt(1000.0) * one.alpha).to_numpy()
    assert abs(noise.var() - np.diag(np.linalg.inv(p)).mean()) < 0.12
    again = workflows.simulate_populations(m, v.repartition(5), [1000.0, 4000.0], h2, [0.5], alpha=-1.0, seed=2).toPandas().sort_values(["population", "row_nr"])
    assert np.allclose(again.z, rows.sort_values(["population", "row_nr"]).z)


def test_polygenicity_by_annotation_and_missing_rows(spark):
    m, v = population_tables(spark)
    h2 = np.diag([0.4, 0.3])
    link = lambda rows: 0.1 + F.col("coding") * 0.9
    out = workflows.simulate_populations(m, v, [1000.0, 1000.0], h2, [0.1, 0.1], [h2, 4 * h2], link, True, -1.0, 0.25, 3).join(v.select("row_nr", "coding"), "row_nr").toPandas()
    one = out[out.population == 0]
    assert 0.7 < len(one) / 1200 < 0.8
    rate = one.groupby("coding").beta_per_allele.apply(lambda b: (b != 0).mean())
    assert rate[1.0] > 5 * rate[0.0] and 0.15 < (one.beta_per_allele != 0).mean() < 0.26
    with pytest.raises(ValueError, match="weights"):
        workflows.simulate_populations(m, v, [1.0, 1.0], h2, [0.9, 0.2])


def test_layouts_of_simulated_statistics(spark, tmp_path):
    from blockweave.sources import stores

    rows = spark.createDataFrame([("rs1", 1, 5, "A", "C", 2.0, 100.0, 0.5), ("NA", 1, 6, "A", "C", 1.0, 100.0, 0.5), ("rs3", 2, 7, "G", "T", -1.0, 400.0, 0.2)], "SNP string, CHR int, POS int, REF string, ALT string, Z double, N double, AF double")
    heads = {"ldgm": "SNP CHR POS REF ALT Z N", "prscs": "SNP A1 A2 BETA P", "ldsc": "SNP A1 A2 N Z", "ldpred": "CHR POS SNP_ID REF ALT REF_FRQ PVAL BETA SE N"}
    for layout, head in heads.items():
        stores.write_sumstats(rows, f"{tmp_path}/{layout}", layout)
        got = spark.read.csv(f"{tmp_path}/{layout}", sep="\t", header=True, inferSchema=True)
        assert got.columns == head.split() and got.count() == 2
    got = {r.SNP_ID: r for r in spark.read.csv(f"{tmp_path}/ldpred", sep="\t", header=True, inferSchema=True).collect()}
    assert np.isclose(got["rs1"].BETA, 0.2 / np.sqrt(0.5)) and np.isclose(got["rs1"].SE, 0.1 / np.sqrt(0.5)) and np.isclose(got["rs1"].PVAL, 0.0455, atol=1e-4)
    assert {r.SNP: (r.A1, r.A2) for r in spark.read.csv(f"{tmp_path}/prscs", sep="\t", header=True).collect()}["rs3"] == ("T", "G")


def test_fit_summaries(spark):
    p = np.diag([2.0, 3.0, 2.5]) + np.array([[0, 0.4, 0], [0.4, 0, -0.3], [0, -0.3, 0]])
    r = np.linalg.inv(p)
    frame = lambda x, keep: spark.createDataFrame([("b", int(i), int(j), float(x[i, j])) for i, j in np.argwhere(keep)], "block_id string, i int, j int, value double")
    exact = precision.fit_summary(frame(p, p != 0), frame(r, p != 0)).first()
    assert exact.mse < 1e-20 and np.isclose(exact.degree, 4 / 3)
    off = precision.fit_summary(frame(p, p != 0), frame(r + 0.1, p != 0)).first()
    assert np.isclose(off.mse, 0.01)


# ---- estimation and providers


def objective(p, c):
    return float(np.sum(p * c) - np.linalg.slogdet(p)[1])


def plain_estimate(c, support, steps=4000):
    """Gradient descent with backtracking on the unpenalised likelihood over the support."""
    p, rate = np.diag(1 / np.diag(c)), 0.5
    for _ in range(steps):
        g = (c - np.linalg.inv(p)) * support
        while True:
            new = p - rate * g
            if np.linalg.eigvalsh(new)[0] > 0 and objective(new, c) <= objective(p, c) - 1e-4 * rate * (g * g).sum():
                break
            rate /= 2
            if rate < 1e-12:
                return p
        p, rate = new, min(1.0, rate * 1.5)
        if np.abs(g).max() < 1e-7:
            break
    return p


def test_two_phases_reach_the_optimum_on_the_chosen_edges(spark):
    from blockweave.functions import kernels

    rng = np.random.default_rng(6)
    n = 60
    p = np.diag(rng.uniform(2, 3, n))
    for i in range(n - 1):
        p[i, i + 1] = p[i + 1, i] = rng.uniform(-0.9, 0.9)
    r = np.linalg.inv(p)
    r /= np.sqrt(np.outer(np.diag(r), np.diag(r)))
    support = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 3
    c = r * support
    frame = spark.createDataFrame([("b", int(i), int(j), float(c[i, j])) for i, j in np.argwhere(support)], "block_id string, i int, j int, value double")
    got = np.zeros((n, n))
    for row in precision.estimate_precision(frame, 0.05, 60, 5).collect():
        got[row.i, row.j] = row.value
    chosen = got != 0
    assert chosen.sum() < support.sum() and np.linalg.eigvalsh(got)[0] > 0
    want = plain_estimate(c, chosen)
    assert abs(objective(got, c) - objective(want, c)) < 1e-6 and np.abs((np.linalg.inv(got) - c)[chosen]).max() < 1e-4
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    assert np.linalg.eigvalsh(kernels.mended(bad))[0] > 0
    assert np.allclose(kernels.lasso_precision(np.eye(2), np.ones((2, 2), bool), start=bad), np.eye(2), atol=1e-6)


def test_correlations_by_path_distance(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (80, 6))
    x[:, 4] = 0
    x[0, 4] = 1  # rare
    g = spark.createDataFrame([(r, v, float(x[r, v])) for r in range(80) for v in range(6)], "row int, variant int, value double")
    graph = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.7), (1, 2, 3.9), (2, 3, 4.0), (3, 4, 0.1), (5, 5, 0.0), (5, 0, 1.0)], "`from` int, `to` int, weight double")
    got = {(r["from"], r["to"]): r.r for r in workflows.correlation_edgelist(graph, g, 4.0, 0.05).collect()}
    cor = np.corrcoef(x.T)
    assert got.keys() == {(0, 1), (1, 2), (0, 5), *((k, k) for k in (0, 1, 2, 3, 5))} and all(np.isclose(r, cor[a, b]) for (a, b), r in got.items())


def test_only_wanted_blocks_are_fetched(spark, tmp_path):
    import pandas as pd

    from blockweave.sources import providers

    log = str(tmp_path)

    def fetch(block, columns):
        with open(f"{log}/{block['block_id']}", "a") as f:
            f.write(",".join(columns) + "\n")
        if block["block_id"] == "b3":
            raise KeyError("gone")
        n = 0 if block["block_id"] == "b1" else 2
        return pd.DataFrame({"CHR": [1] * n, "POS": [block["chromStart"] + k for k in range(n)], "SNP": [f"rs{k}" for k in range(n)], "Z": [0.5] * n})[columns]

    catalog = spark.createDataFrame([(f"b{k}", 1, 100 * k, 100 * k + 100) for k in range(5)], "block_id string, chrom int, chromStart long, chromEnd long")
    own = providers.Provider({"CHR": "int", "POS": "long", "SNP": "string", "Z": "double"}, partition=fetch)
    got = providers.provide(spark, own, catalog.where("chromStart < 300"), ["Z"])
    assert got.columns == ["block_id", "CHR", "POS", "Z"] and {(r.block_id, r.POS) for r in got.collect()} == {("b0", 0), ("b0", 1), ("b2", 200), ("b2", 201)}
    assert {f: open(f"{log}/{f}").read() for f in sorted(os.listdir(log))} == {f"b{k}": "CHR,POS,Z\n" for k in range(3)}
    with pytest.raises(Exception, match="block b3"):
        providers.provide(spark, own, catalog.where("block_id = 'b3'")).collect()
    whole = providers.Provider(own.types, frame=lambda s, c: s.createDataFrame([(1, 250, "rs", 1.0), (1, 950, "rs", 1.0)], "CHR int, POS long, SNP string, Z double").select(*c))
    assert [(r.block_id, r.POS) for r in providers.provide(spark, whole, catalog).collect()] == [("b2", 250)]
    with pytest.raises(ValueError, match="neither"):
        providers.provide(spark, providers.Provider(own.types), catalog)


def test_all_populations_of_a_catalog(spark, tmp_path):
    from blockweave.sources import readers

    for name, w in (("x", 0.3), ("y", -0.2)):
        (tmp_path / f"{name}.edgelist").write_text(f"0,0,2\n1,1,2\n2,2,1\n0,1,{w}\n")
        (tmp_path / f"{name}.snplist").write_text("index,anc_alleles,deriv_alleles,EUR,site_ids,position,swap\n0,A,C,0.1,rs0,10,+\n0,A,C,0.4,rs1,11,+\n1,AT,C,0.2,rs2,20,+\n1,G,C,0.3,rs3,21,+\n2,A,G,0.5,rs4,30,+\n")
    catalog = readers.block_catalog(spark.createDataFrame([(1, 0, 50, f"{n}.edgelist", f"{n}.snplist", "EUR") for n in ("x", "y")], "chrom int, chromStart long, chromEnd long, name string, snplistName string, population string"), "EUR")
    matrix, variants = readers.load_populations(spark, catalog, str(tmp_path))
    assert all(np.isclose(r.y, 1.0) for r in precision.inverse_diagonal(matrix).collect()) and matrix.select("block_id").distinct().count() == 2
    got = {(r.site_ids, r.af) for r in variants.collect()}
    assert "rs2" not in {s for s, _ in got} and ("rs1", 0.1) in got and ("rs3", 0.3) in got


def test_scores_of_genes_and_gene_sets(spark):
    from blockweave.sources import stores

    rows = spark.createDataFrame([(0, 1, 90), (1, 1, 220), (2, 1, 280)], "row_id long, CHR int, POS long")
    genes = spark.createDataFrame([(0, "g0", "A", 1, 100), (1, "g1", "B", 1, 200), (2, "g2", "C", 1, 300)], "gene_row long, gene_id string, gene_name string, CHR int, POS long")
    values = spark.createDataFrame([(0, 1.0, "x"), (1, 2.0, "y"), (2, 4.0, "z")], "row_id long, gradient double, note string")
    got = {r.gene_id: r.gradient for r in stores.gene_score_rows(rows, values, genes.withColumnRenamed("CHR", "CHR"), [0.7, 0.3], ["gradient", "note"]).collect()}
    assert np.isclose(got["g0"], 0.7) and np.isclose(got["g1"], 0.3 + 0.7 * 2 + 0.3 * 4) and np.isclose(got["g2"], 0.3 * 2 + 0.7 * 4)
    sets = spark.createDataFrame([(0, "setA", "A"), (0, "setA", "C"), (1, "setB", "B")], "set_row long, set_name string, gene string")
    table = {r.row_id: (r.setA, r.setB) for r in stores.gene_set_values(rows, genes, sets, [0.7, 0.3]).collect()}
    assert {k: tuple(np.round(v, 9)) for k, v in table.items()} == {0: (0.7, 0.3), 1: (0.3, 0.7), 2: (0.7, 0.3)}


def test_small_blocks_spread_over_tasks(spark):
    """Blocks are few in bytes, but aren't merged into one task; not even where rows are by block_id already."""
    m = precision.sparse_precision(spark.range(64).select(F.concat(F.lit("b"), "id").alias("block_id"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2.0).alias("value")))
    ids = m.select("block_id").distinct()
    for table in (precision.packed(m), precision.packed(m, ids), precision.packed(m, ids.withColumn("x", F.lit(1.0)))):
        tasks = table.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) >= 6 and sum(t["count"] for t in tasks) == 64
    assert {tuple(r.rows[0]) for r in precision.packed(m).collect()} == {(f"b{k}",) for k in range(64)}
    assert precision.log_determinant(m.where("false")).count() == 0
