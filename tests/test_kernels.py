"""Goldens of the block algebra on a three-node matrix, and properties against dense algebra."""

import math

import numpy as np
import pytest

from blockweave.functions import kernels as K
from blockweave.functions.kernels import log_normal_tail
from blockweave.functions.sparse import Sparse


@pytest.fixture
def p():
    a = np.random.default_rng(0).standard_normal((12, 12))
    return a @ a.T + 12 * np.eye(12)


def test_views_agree_with_dense_algebra(p):
    active = np.array([7, 2, 9])
    r = np.linalg.inv(p)[np.ix_(active, active)]
    view = np.linalg.inv(r)
    x = np.arange(3.0) + 1
    assert np.allclose(K.multiply(p, x, active), view @ x)
    assert np.allclose(K.solve(p, x, active), r @ x)
    assert np.allclose(K.schur(p, active), view)
    assert math.isclose(K.logdet(p, active), np.linalg.slogdet(view)[1], rel_tol=1e-10)


@pytest.mark.parametrize("method", ["hutchinson", "xnys"])
def test_estimators_are_exact_for_complete_probes(p, method):
    n = len(p)
    z = np.linalg.qr(np.random.default_rng(1).standard_normal((n, n)))[0] * np.sqrt(n) if method == "hutchinson" else np.eye(n)
    got = K.inverse_diagonal(p, method, np.sqrt(n) * np.eye(n) if method == "hutchinson" else z)
    assert np.allclose(got, np.diag(np.linalg.inv(p)))


def test_blup_of_identity_is_shrinkage():
    z = np.array([1.0, -2.0])
    assert np.allclose(K.blup(np.eye(2), z, 100.0, 0.5), 10 * 0.5 * z / 51)


def test_clump_golden():
    r = np.eye(4)
    r[0, 1] = r[1, 0] = 0.8
    assert K.clump(np.linalg.inv(r), np.array([5.0, 4, 6, 10]), np.arange(4), 0.5, 10.0).tolist() == [True, False, True, True]
    assert K.clump(np.linalg.inv(r), np.array([5.0, 4, 6, 3]), np.arange(4), 0.5, 10.0).tolist() == [True, False, True, False]


def test_gradient_is_the_finite_difference():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((5, 5))
    base, dm, pz = a @ a.T + 5 * np.eye(5), rng.random((5, 2)), rng.standard_normal(5)
    at = lambda t: K.likelihood(base + np.diag(dm @ t), pz)
    g = K.likelihood_gradient(base, pz, dm)
    for k in range(2):
        e = np.zeros(2)
        e[k] = 1e-5
        assert math.isclose(g[k], (at(e) - at(-e)) / 2e-5, rel_tol=1e-5, abs_tol=1e-7)


def test_imputation_quality_control_and_estimation(p):
    r = np.linalg.inv(p)
    r /= np.sqrt(np.outer(np.diag(r), np.diag(r)))
    z = np.linalg.cholesky(r) @ np.ones(12)
    q, nodes, seen = np.linalg.inv(r), np.arange(12), np.arange(12) % 3 > 0
    some, z_some = nodes[:9], z[:9]  # the last three nodes have no row
    ra, first = r[:9, :9], seen[:9]
    want = z_some.copy()
    want[~first] = ra[np.ix_(~first, first)] @ np.linalg.solve(ra[np.ix_(first, first)], z_some[first])
    assert np.allclose(K.impute(q, some, z_some, first), want)
    chi2 = K.halves_chi2(q, some, z_some, first)
    for own in (first, ~first):
        w = np.linalg.solve(ra[np.ix_(~own, ~own)], ra[np.ix_(~own, own)])
        assert np.allclose(chi2[own], (z_some[own] - w.T @ z_some[~own]) ** 2 / (np.diag(ra)[own] - (w * ra[np.ix_(~own, own)]).sum(0)))
    assert np.allclose(K.regularise(q, nodes, z, 0.0), z)
    assert np.allclose(K.regularise(q, some, z_some, 0.3), ra @ np.linalg.solve(0.7 * ra + 0.3 * np.eye(9), z_some))
    q = K.lasso_precision(r, np.ones((12, 12), bool), sweeps=60)
    assert np.abs(q @ r - np.eye(12)).max() < 0.05


def test_normal_tail():
    assert math.isclose(log_normal_tail(np.array([1.959964]))[0], math.log(0.025), rel_tol=1e-6)
    assert math.isclose(log_normal_tail(np.array([40.0]))[0], -804.6084420137538, rel_tol=1e-9)


def banded(n, per_node, span, seed=0):
    """A positive definite matrix of n nodes with neighbours within a span."""
    rng = np.random.default_rng(seed)
    i = rng.integers(0, n, n * per_node)
    j = np.clip(i + rng.integers(1, span + 1, n * per_node), 0, n - 1)
    i, j = i[i != j], j[i != j]
    v = rng.normal(0, 0.2, len(i))
    p = Sparse(n, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v]))
    return p.with_diagonal(np.arange(n), np.bincount(p.i, np.abs(p.value), n) + 0.5)


@pytest.mark.parametrize("n,per_node,span", [(1, 1, 1), (7, 2, 3), (60, 3, 5), (300, 4, 12), (300, 3, 300), (1000, 5, 40)])
def test_sparse_factor_equals_dense_algebra(n, per_node, span):
    rng, p = np.random.default_rng(1), banded(n, per_node, span)
    d, f = p.dense(), p.factor
    r, b = np.linalg.inv(d), rng.normal(size=(n, 3))
    assert np.allclose(p.multiply(b), d @ b) and np.allclose(f.solve(b), r @ b, atol=1e-10)
    assert math.isclose(f.logdet, np.linalg.slogdet(d)[1], rel_tol=1e-10, abs_tol=1e-10)
    assert np.allclose(f.inverse_diagonal, np.diag(r)) and np.allclose(f.inverse_entries, r[p.i, p.j])
    at = rng.choice(n, min(n, 5), False)
    assert np.allclose(f.solve_at(b[: len(at)], at), r[np.ix_(at, at)] @ b[: len(at)]) and np.allclose(f.column(at[0]), r[:, at[0]])
    half = f.noise(np.eye(n))
    assert np.allclose(half @ half.T, r, atol=1e-10)
    view = K.View(p, np.sort(at))
    assert np.allclose(np.linalg.inv(np.concatenate([c for _, c in view.columns(2)], 1)), r[np.ix_(view.active, view.active)])


def test_sparse_factor_of_parts_and_of_bad_matrices():
    d = np.kron(np.eye(200), np.array([[2.0, 0.5], [0.5, 1.0]]))  # 200 parts that don't touch
    assert np.allclose(Sparse.of(d).factor.inverse_diagonal, np.tile(np.diag(np.linalg.inv(d[:2, :2])), 200))
    star = np.eye(150) * 4
    star[0, 1:] = star[1:, 0] = 0.1
    assert np.allclose(Sparse.of(star).factor.solve(np.ones(150)), np.linalg.solve(star, np.ones(150)))
    assert len(Sparse(0, [], [], []).factor.solve(np.zeros(0))) == 0
    with pytest.raises(np.linalg.LinAlgError):
        Sparse.of(np.zeros((3, 3))).factor.solve(np.ones(3))
    indefinite = np.diag([1.0, -2.0, 3.0])
    assert np.allclose(Sparse.of(indefinite).factor.solve(np.ones(3)), [1, -0.5, 1 / 3])


def test_a_block_of_five_thousand_nodes_needs_no_dense_matrix():
    p = banded(5000, 5, 60)
    f = p.factor
    assert len(p.value) > 50_000 and f.entries < 5000 * 5000 / 20 and max(len(a) + len(b) for a, b in zip(f.parts, f.edge, strict=True)) < 500
    x = np.random.default_rng(0).normal(size=5000)
    assert np.abs(p.multiply(f.solve(x)) - x).max() < 1e-8
    r = f.column(17)
    assert math.isclose(r[17], f.inverse_diagonal[17], rel_tol=1e-9)


def test_gaussian_of_a_view_equals_dense_algebra():
    p, rng = banded(80, 3, 9), np.random.default_rng(3)
    seen = np.sort(rng.choice(80, 50, False))
    whole = p.with_diagonal(seen, rng.uniform(0.1, 1, 50))
    m = K.schur(whole, seen)
    pz, dm = rng.normal(size=50), rng.random((50, 2))
    g = K.Gaussian(whole, pz, seen)
    b, inverse = np.linalg.solve(m, pz), np.linalg.inv(m)
    assert math.isclose(g.likelihood(), -0.5 * (50 * np.log(2 * np.pi) + np.linalg.slogdet(m)[1] + pz @ b), rel_tol=1e-10)
    assert np.allclose(g.gradient(dm), -0.5 * (np.diag(inverse) - b**2) @ dm)
    assert np.allclose(g.hessian(dm), -0.5 * (dm * b[:, None]).T @ inverse @ (dm * b[:, None]))
    assert np.allclose(g.node_hessian(), -0.5 * np.diag(inverse) * b**2)
    close = g.node_gradient("xdiag", n_samples=45, seed=1)
    assert np.abs(close - g.node_gradient()).max() < 0.1 * np.abs(g.node_gradient()).max()
