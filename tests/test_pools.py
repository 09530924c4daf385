"""Pools of small blocks: what is worked out for all of them at once equals what each block gives alone."""

import numpy as np
import pyarrow as pa
import pytest

from blockweave.functions import kernels as K
from blockweave.functions.sparse import LEAF, Factor, Sparse, Stacks
from blockweave.operators import precision


def matrices(seed=1, sizes=(2, 5, 1, 2, 9, 5, 3)):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        a = np.where(rng.random((n, n)) < 0.6, rng.uniform(-0.6, 0.6, (n, n)), 0.0)
        out.append(a + a.T + np.diag(1.5 + np.abs(a + a.T).sum(1)))
    return out


def pool(blocks):
    starts = np.cumsum([0] + [len(b) for b in blocks[:-1]])
    at = [np.nonzero(b) for b in blocks]
    i, j = (np.concatenate([a[side] + s for a, s in zip(at, starts)]) for side in (0, 1))
    return Sparse(sum(map(len, blocks)), i, j, np.concatenate([b[a] for b, a in zip(blocks, at)]), starts), starts


def views(blocks, starts, seed=2):
    """Some nodes of each block, and the same as nodes of the pool."""
    rng = np.random.default_rng(seed)
    own = [np.sort(rng.choice(len(b), max(1, len(b) * 2 // 3), replace=False)) for b in blocks]
    return own, np.concatenate([o + s for o, s in zip(own, starts)])


def split(x, parts):
    return np.split(x, np.cumsum([len(p) for p in parts])[:-1])


def packed_batch(blocks, rows):
    """One row a block, as ``precision.packed`` makes them."""
    entries = [[{"i": int(i), "j": int(j), "value": float(b[i, j])} for i, j in zip(*np.nonzero(b))] for b in blocks]
    return pa.RecordBatch.from_pydict({"block_id": [f"b{k}" for k in range(len(blocks))], "entries": entries, "rows": rows})


def test_a_thousand_small_blocks_are_one_pool_and_large_or_faulty_ones_are_alone():
    blocks = matrices(3, [2] * 1000) + [np.eye(LEAF + 1), np.zeros((0, 0)), np.eye(2)]
    rows = [[{"block_id": f"b{k}", "i": 0}, {"block_id": f"b{k}", "i": 1}] for k in range(1002)] + [[{"block_id": "b1002", "i": 5}]]
    found = list(precision.pools_of(packed_batch(blocks, rows)))
    assert [len(which) for which, _, _ in found] == [1000, 1, 1, 1]
    _, p, v = found[0]
    assert isinstance(p.factor, Stacks) and (v["_node"] == np.arange(2000)).all() and (v["i"] == p.local[v["_node"]]).all()
    assert [p.n for _, p, _ in found[1:]] == [LEAF + 1, 0, 2] and isinstance(found[1][1].factor, Factor)
    assert [len(w) for w, _, _ in precision.pools_of(packed_batch(blocks, rows), together=False)] == [1] * 1003


def test_pools_end_at_their_number_of_nodes(monkeypatch):
    monkeypatch.setattr(precision, "POOL_NODES", 20)
    found = list(precision.pools_of(packed_batch(matrices(4, [3] * 50), [[{"block_id": f"b{k}", "i": 0}] for k in range(50)])))
    assert len(found) > 5 and max(p.n for _, p, _ in found) <= 20 + LEAF
    assert np.concatenate([which for which, _, _ in found]).tolist() == list(range(50))


# ---- F9 r5_reml_fit


def test_likelihoods_gradients_and_hessians_of_a_pool_are_those_of_each_block():
    blocks = matrices(5)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    rng = np.random.default_rng(6)
    pz, slope = rng.normal(size=len(nodes)), rng.uniform(size=(len(nodes), 2))
    g = K.Gaussian(p, pz, nodes)
    for k, (b, o, z, s) in enumerate(zip(blocks, own, split(pz, own), split(slope, own))):
        one = K.Gaussian(b, z, o)
        assert np.isclose(g.likelihoods()[k], one.likelihood(), rtol=1e-12)
        assert np.allclose(g.gradients(slope)[k], one.gradient(s), atol=1e-12) and np.allclose(g.hessians(slope)[k], one.hessian(s), atol=1e-12)


# ---- F10 r5_reml_first_step


def state_batch(blocks, seed=7):
    """A batch of REML states by hand, with a block without variants in the middle."""
    rng, out = np.random.default_rng(seed), []
    for k, b in enumerate(blocks):
        i, j = np.nonzero(b)
        entries = [{"i": int(x), "j": int(y), "value": float(b[x, y])} for x, y in zip(i, j)]
        if k == 3:
            out.append({"block_id": f"b{k}", "entries": entries, "nodes": None, "pz": None, "rest_logdet": None, "place": None, "row_nr": None, "annotations": None})
            continue
        nodes = np.arange(len(b))[: max(1, len(b) - 1)]
        rest = b[len(nodes) :, len(nodes) :]
        place = np.concatenate([np.arange(len(nodes)), [0]])
        out.append({"block_id": f"b{k}", "entries": entries, "nodes": nodes.tolist(), "pz": rng.normal(size=len(nodes)).tolist(), "rest_logdet": float(np.linalg.slogdet(rest)[1]) if len(rest) else 0.0,
                    "place": place.tolist(), "row_nr": list(range(len(place))), "annotations": rng.uniform(size=2 * len(place)).tolist()})
    return pa.RecordBatch.from_pylist(out)


def test_states_of_small_blocks_are_evaluated_as_one_pool():
    batch = state_batch(matrices(8))
    found = list(precision.reml_blocks(batch, np.array([0.5, -0.2]), 100.0, 10.0, 1.0))
    assert [b.which.tolist() for b in found] == [[0, 1, 2, 4, 5, 6]]


# ---- F11 c1_run_clump


def test_clumps_of_a_pool_are_those_of_each_block():
    blocks = matrices(9, [12, 2, 7, 20, 1, 12])
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    z = np.round(np.random.default_rng(10).normal(size=len(nodes)) * 4)  # with ties
    got = split(K.clump(p, z, nodes, 0.001, 4.0), own)
    alone = [K.clump(b, x, o, 0.001, 4.0) for b, x, o in zip(blocks, split(z, own), own)]
    assert all((a == b).all() for a, b in zip(got, alone)) and max(a.sum() for a in alone) > 1
    for b, o, x, lead in zip(blocks, own, split(z, own), got):  # one after another
        r2, pruned, want = np.linalg.inv(b)[np.ix_(o, o)] ** 2, np.zeros(len(o), bool), np.zeros(len(o), bool)
        for k in np.argsort(-(x**2), kind="stable"):
            if not pruned[k] and x[k] ** 2 >= 4:
                want[k] = True
                pruned |= r2[k] >= 0.001
        assert (want == lead).all()


# ---- F12 r3_reml_terms_pairs


def test_terms_of_a_pool_of_states_are_those_of_states_alone():
    batch = state_batch(matrices(11))
    (whole,) = precision.reml_blocks(batch, np.array([0.5, -0.2]), 100.0, 10.0, 1.0)
    for k, at in enumerate(whole.which):
        (one,) = precision.reml_blocks(batch.slice(int(at), 1), np.array([0.5, -0.2]), 100.0, 10.0, 1.0)
        assert np.isclose(whole.gaussian.likelihoods()[k], one.gaussian.likelihood(), rtol=1e-12)
        mine = whole.gaussian.view.block == k
        assert np.allclose(whole.gaussian.node_gradient()[mine], one.gaussian.node_gradient(), atol=1e-12)
        assert np.allclose(whole.eta[whole.gaussian.view.block[whole.place] == k], one.eta)


# ---- F14 j13_surrogate_markers


def test_surrogates_of_a_pool_are_those_of_each_block():
    blocks = matrices(12, [6, 2, 9, 3])
    p, starts = pool(blocks)
    have = [np.array([0, 3, 4]), np.array([1]), np.array([2, 5, 8]), np.array([0])]
    lack = [np.array([1, 2, 5]), np.array([0]), np.array([7, 1]), np.zeros(0, int)]
    got = K.most_correlated(p, np.concatenate([x + s for x, s in zip(lack, starts)]), np.concatenate([x + s for x, s in zip(have, starts)]))
    want = [h[(np.linalg.inv(b)[np.ix_(x, h)] ** 2).argmax(1)] + s for b, x, h, s in zip(blocks, lack, have, starts) if len(x)]
    assert got.tolist() == np.concatenate(want).tolist()
    with pytest.raises(ValueError, match="no variant with a Z"):
        K.most_correlated(p, np.array([0, 7]), np.array([1]))


# ---- F15 b2_run_blup


def test_weights_of_a_pool_are_those_of_each_block_with_its_own_sample_size():
    blocks = matrices(13)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    z, n = np.random.default_rng(14).normal(size=len(nodes)), 100.0 + np.arange(len(blocks))
    got = K.blup(p, z, n[p.block[nodes]], 0.25, nodes)
    alone = [K.blup(b, x, m, 0.25, o) for b, x, m, o in zip(blocks, split(z, own), n, own)]
    assert np.allclose(got, np.concatenate(alone), rtol=1e-12)


# ---- F16 q1_impute


def test_imputed_values_of_a_pool_are_those_of_each_block():
    blocks = matrices(15)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    z, seen = np.random.default_rng(16).normal(size=len(nodes)), np.random.default_rng(17).random(len(nodes)) < 0.5
    alone = [K.impute(b, o, x, s) for b, o, x, s in zip(blocks, own, split(z, own), split(seen, own))]
    assert np.allclose(K.impute(p, nodes, z, seen), np.concatenate(alone), rtol=1e-12)


# ---- F17 l8_variant_solve


def test_solutions_of_a_pool_are_those_of_each_block_and_a_singular_block_is_an_error():
    blocks = matrices(18)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    b = np.random.default_rng(19).normal(size=(len(nodes), 3))
    assert np.allclose(K.solve(p, b, nodes), np.concatenate([K.solve(m, x, o) for m, x, o in zip(blocks, split(b, own), own)]), rtol=1e-12)
    assert np.allclose(K.multiply(p, b[:, 0], nodes), np.concatenate([K.multiply(m, x, o) for m, x, o in zip(blocks, split(b[:, 0], own), own)]), rtol=1e-11)
    with pytest.raises(np.linalg.LinAlgError):
        pool([np.eye(2), np.zeros((2, 2)) + 1.0])[0].factor  # noqa: B018


# ---- F18 s23_normalise


def test_inverse_diagonal_of_a_pool_is_that_of_each_block():
    blocks = matrices(20)
    p, _ = pool(blocks)
    assert np.allclose(K.inverse_diagonal(p), np.concatenate([np.diag(np.linalg.inv(b)) for b in blocks]), rtol=1e-11)


# ---- F19 l7_selected_log_determinant


def test_log_determinants_and_entries_of_views_of_a_pool_are_those_of_each_block():
    blocks = matrices(21)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    view = K.View(p, nodes)
    assert np.allclose(view.logdets, [K.logdet(b, o) for b, o in zip(blocks, own)], atol=1e-12)
    ((first, m),) = view.columns()
    for k, (b, o) in enumerate(zip(blocks, own)):
        assert first == 0 and np.allclose(m[view.block == k][:, : len(o)], K.schur(b, o), atol=1e-12)


# ---- F20 q4_project_weights


def test_products_of_a_view_that_leaves_whole_blocks_out():
    blocks = matrices(22)
    p, starts = pool(blocks)
    to = np.array([0, 3, 4]) + np.array([0, starts[1], starts[1]])
    full = np.random.default_rng(23).normal(size=p.n)
    got = K.multiply(p, p.factor.solve(full)[to], to)
    x0, x1 = (np.linalg.solve(b, x) for b, x in zip(blocks[:2], np.split(full, starts[1:])))
    assert np.allclose(got, np.concatenate([K.multiply(blocks[0], x0[:1], np.array([0])), K.multiply(blocks[1], x1[[3, 4]], np.array([3, 4]))]), rtol=1e-10)


# ---- F21 e1_estimate_precision


def test_estimates_of_a_stack_are_those_of_each_matrix():
    blocks = np.stack([np.linalg.inv(b) for b in matrices(24, [4] * 6)])
    blocks /= np.sqrt(np.einsum("bi,bj->bij", *[np.diagonal(blocks, axis1=1, axis2=2)] * 2))
    support = np.random.default_rng(25).random((6, 4, 4)) < 0.6
    support |= support.transpose(0, 2, 1) | np.eye(4, dtype=bool)
    for penalty, sweeps in ((0.0, 60), (0.05, 7)):
        got = K.lasso_precision(blocks, support, penalty, sweeps)
        assert np.allclose(got, [K.lasso_precision(c, s, penalty, sweeps) for c, s in zip(blocks, support)], atol=1e-12)
    assert np.allclose(np.linalg.inv(K.lasso_precision(blocks, support, 0.0, 500))[support], blocks[support], atol=1e-6)
    assert np.allclose(K.two_phase_precision(blocks, support, 0.05), [K.two_phase_precision(c, s, 0.05) for c, s in zip(blocks, support)], atol=1e-10)


# ---- F22 m1_simulate


def test_noise_of_a_pool_is_that_of_each_block():
    blocks = matrices(26)
    p, starts = pool(blocks)
    x = np.random.default_rng(27).normal(size=p.n)
    alone = [Sparse.of(b).factor.noise(part) for b, part in zip(blocks, np.split(x, starts[1:]))]
    assert np.allclose(p.factor.noise(x), np.concatenate(alone), rtol=1e-11)


# ---- F23 r3_reml_terms


def test_states_are_alone_where_diagonals_are_estimated_and_together_where_they_are_exact():
    batch = state_batch(matrices(28))
    theta = np.array([0.5, -0.2])
    assert [len(b.which) for b in precision.reml_blocks(batch, theta, 100.0, 10.0, 1.0, "xdiag")] == [1] * 6
    assert [len(b.which) for b in precision.reml_blocks(batch, theta, 100.0, 10.0, 1.0, "exact")] == [6]
    assert not list(precision.reml_blocks(batch.slice(3, 1), theta, 100.0, 10.0, 1.0))


# ---- F24 q2_outlier_chi2


def test_chi_squares_of_a_pool_are_those_of_each_block():
    blocks = matrices(29)
    p, starts = pool(blocks)
    own, nodes = views(blocks, starts)
    z, first = np.random.default_rng(30).normal(size=len(nodes)), np.random.default_rng(31).random(len(nodes)) < 0.5
    alone = [K.halves_chi2(b, o, x, h) for b, o, x, h in zip(blocks, own, split(z, own), split(first, own))]
    assert np.allclose(K.halves_chi2(p, nodes, z, first), np.concatenate(alone), rtol=1e-10)
    alone = [K.regularise(b, o, x, 0.3) for b, o, x in zip(blocks, own, split(z, own))]
    assert np.allclose(K.regularise(p, nodes, z, 0.3), np.concatenate(alone), rtol=1e-11)


# ---- F25 q4_score_accuracy


def test_quadratic_forms_of_a_pool_are_sums_over_blocks():
    blocks = matrices(32)
    p, starts = pool(blocks)
    w, t = np.random.default_rng(33).normal(size=(2, p.n))
    want = sum(a @ np.linalg.solve(b, c) for b, a, c in zip(blocks, np.split(w, starts[1:]), np.split(t, starts[1:])))
    assert np.isclose(w @ K.solve(p, t), want, rtol=1e-11)
