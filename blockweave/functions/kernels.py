"""Kernels for one block, or for a pool of small ones: views, estimators, likelihood. No Spark here.

P is a block's precision matrix, the inverse of the correlation matrix R; "solve" multiplies by R.
``active`` are the node numbers of a view, in its order; a view's matrix is the Schur complement. In a pool a view has nodes of
all blocks, sums are by block, and what is done for one node after another is done for one of every block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from blockweave.functions.sparse import Sparse, _ranges


def log_normal_tail(z: np.ndarray) -> np.ndarray:
    """Natural log of the upper normal tail for z >= 0, without underflow."""
    z = np.asarray(z, float)
    near = np.array([0.5 * math.erfc(x / math.sqrt(2)) if x < 30 else 1.0 for x in z])
    far = np.where(z > 0, z, 1.0)
    series = 1 - 1 / far**2 + 3 / far**4 - 15 / far**6
    return np.where(z < 30, np.log(near), -far * far / 2 - np.log(far) - 0.5 * math.log(2 * math.pi) + np.log(np.where(z < 30, 1.0, series)))


class View:
    """Some nodes of a matrix: its Schur complement, never formed. A solve needs the whole's factor, a product that of the other nodes."""

    def __init__(self, p: Sparse | np.ndarray, active: np.ndarray | None = None):
        self.p = Sparse.of(p)
        self.active = np.arange(self.p.n) if active is None else np.asarray(active)
        self.rest = np.setdiff1d(np.arange(self.p.n), self.active)

    def __len__(self) -> int:
        return len(self.active)

    @cached_property
    def others(self) -> Sparse:
        return self.p.take(self.rest)

    def padded(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((self.p.n, *x.shape[1:]))
        full[self.active] = x
        return full

    def solve(self, b: np.ndarray) -> np.ndarray:
        """b is padded with zeros, the whole system solved and the view read off."""
        return self.p.factor.solve_at(b, self.active)

    def multiply(self, x: np.ndarray) -> np.ndarray:
        """(P_aa - P_ar P_rr^-1 P_ra) x."""
        y = self.p.multiply(self.padded(x))
        if not len(self.rest):
            return y[self.active]
        full = np.zeros_like(y)
        full[self.rest] = self.others.factor.solve(y[self.rest])
        return y[self.active] - self.p.multiply(full)[self.active]

    @property
    def logdets(self) -> np.ndarray:
        """log |det| of the whole less that of the other nodes, by block."""
        return self.p.factor.logdets - (self.others.factor.logdets if len(self.rest) else 0.0)

    @property
    def logdet(self) -> float:
        return float(self.logdets.sum())

    @cached_property
    def block(self) -> np.ndarray:
        return self.p.block[self.active]

    @cached_property
    def rank(self) -> np.ndarray:
        """The place of each node among those of its block, in the view's order."""
        order = np.argsort(self.block, kind="stable")
        count = np.bincount(self.block, minlength=len(self.p.starts))
        out = np.empty(len(self), np.int64)
        out[order] = _ranges(np.zeros(len(count), np.int64), count)
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Values of the view's nodes added up by block."""
        return np.bincount(self.block, x, len(self.p.starts))

    @property
    def inverse_diagonal(self) -> np.ndarray:
        return self.p.factor.inverse_diagonal[self.active]

    def columns(self, size: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """The view's matrix, some columns at a time, each with the number of its first; those of one rank in all blocks are one column."""
        widest = int(self.rank.max()) + 1 if len(self) else 0
        for at in range(0, widest, size):
            unit = np.zeros((len(self), min(size, widest - at)))
            here = np.flatnonzero((self.rank >= at) & (self.rank < at + unit.shape[1]))
            unit[here, self.rank[here] - at] = 1.0
            yield at, self.multiply(unit)


def solve(p: Sparse | np.ndarray, b: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
    return View(p, active).solve(b)


def multiply(p: Sparse | np.ndarray, x: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
    return View(p, active).multiply(x)


def schur(p: Sparse | np.ndarray, active: np.ndarray) -> np.ndarray:
    """A small view's matrix."""
    return np.concatenate([c for _, c in View(p, active).columns()], 1) if len(active) else np.zeros((0, 0))


def logdet(p: Sparse | np.ndarray, active: np.ndarray | None = None) -> float:
    return View(p, active).logdet


def probes(n: int, m: int, seed: int) -> np.ndarray:
    """Rademacher probes, n x min(n, m)."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (n, min(n, m)))


def inverse_diagonal(p: View | Sparse | np.ndarray, method: str = "exact", z: np.ndarray | None = None, n_samples: int = 100, seed: int = 0) -> np.ndarray:
    """Diagonal of the inverse: exact, from the factor's own pattern, or estimated by hutchinson, xdiag or xnys from probes ``z``, by solves alone.

    Without ``z`` probes are drawn, for xdiag anew (at most 20 times) while they are not independent; where they would be as many as nodes, the exact diagonal is given.
    """
    view = p if isinstance(p, View) else View(p)
    n = len(view)
    if method == "exact" or z is None and n <= n_samples:
        return view.inverse_diagonal.copy()
    if z is None:
        drawn = (probes(n, n_samples, seed + 7919 * k) for k in range(20))
        z = next((x for x in drawn if method != "xdiag" or np.linalg.matrix_rank(x) == x.shape[1]), None)
        if z is None:
            raise np.linalg.LinAlgError("probes are rank deficient")
    y = view.solve(z)
    if method == "hutchinson":
        return (z * y).mean(1)
    if method == "xdiag":
        # low-rank part by QR of the images; the rest by probes, each without its own column
        q, r = np.linalg.qr(y)
        if np.min(np.abs(np.diag(r))) <= 1e-12 * np.max(np.abs(r)):
            raise np.linalg.LinAlgError("probes are rank deficient")
        m = z.shape[1]
        s = np.linalg.inv(r).T
        s /= np.linalg.norm(s, axis=0)
        image = view.solve(q).T
        low = (q * image.T).sum(1)
        proj = q @ s
        first = low - (proj * (image.T @ s)).sum(1) / m
        resid = y - q @ (image @ z)
        inner = np.einsum("ij,ij->j", s, image @ z)
        second = z * (resid + proj * inner)
        return first + second.mean(1)
    if method == "xnys":
        gram = z.T @ y
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > np.sqrt(np.finfo(float).eps) * max(values.max(), 1.0)
        half = y @ (vectors[:, keep] / np.sqrt(values[keep]))
        return (half**2).sum(1)
    raise ValueError(f"unknown method {method}")


def blup(p: Sparse | np.ndarray, z: np.ndarray, n: float | np.ndarray, sigma2: float, active: np.ndarray | None = None) -> np.ndarray:
    """sqrt(N) s2 (P + N s2 I)^-1 P z, with the diagonal added at the active nodes; N may be given for each of them."""
    view = View(p, active)
    raised = View(view.p.with_diagonal(view.active, n * sigma2), view.active)
    return np.sqrt(n) * sigma2 * raised.solve(view.multiply(z))


def clump(p: Sparse | np.ndarray, z: np.ndarray, active: np.ndarray, rsq: float = 0.1, chi2: float = 30.0) -> np.ndarray:
    """Lead flags: by falling chi-square, each unpruned variant prunes those correlated with it. One factor, and one solve for a lead of each block."""
    p = Sparse.of(p)
    block, lead, left = p.block[active], np.zeros(len(z), bool), z**2 >= chi2
    order = np.lexsort([-(z**2), block])
    while left.any():
        now = order[left[order]]
        _, at = np.unique(block[now], return_index=True)
        best = now[at]
        here = np.zeros(len(p.starts), bool)
        here[block[best]] = True
        hit = (p.factor.column(active[best])[active] ** 2 >= rsq) & here[block]
        if not hit[best].all():
            raise ValueError("a lead variant is not in LD with itself")
        lead[best] = True
        left &= ~hit
    return lead


def most_correlated(p: Sparse, lack: np.ndarray, have: np.ndarray) -> np.ndarray:
    """For each node of ``lack`` the node of ``have`` (ascending) in its block whose squared correlation with it is highest, the smallest of equal ones."""
    own, best = p.block[have], np.empty(len(lack), np.int64)
    if not np.isin(p.block[lack], own).all():
        raise ValueError("a block has no variant with a Z")
    blocks, at = np.unique(own, return_index=True)
    rank = View(p, lack).rank
    for k in range(int(rank.max(initial=-1)) + 1):
        now = np.flatnonzero(rank == k)
        r2 = p.factor.column(lack[now])[have] ** 2
        top = np.flatnonzero(r2 == np.repeat(np.maximum.reduceat(r2, at), np.diff(np.append(at, len(have)))))
        _, first = np.unique(own[top], return_index=True)
        best[now] = have[top[first]][np.searchsorted(blocks, p.block[lack[now]])]
    return best


class Gaussian:
    """Likelihood of Pz of some nodes, whose covariance is a view of ``m``, and its derivatives, from one factor."""

    def __init__(self, m: Sparse | np.ndarray, pz: np.ndarray, seen: np.ndarray | None = None, rest_logdet: float | np.ndarray | None = None):
        self.view, self.pz = View(m, seen), pz
        self.logdets = self.view.logdets if rest_logdet is None else self.view.p.factor.logdets - rest_logdet
        self.full = self.view.p.factor.solve(self.view.padded(pz))
        self.b = self.full[self.view.active]

    def likelihoods(self) -> np.ndarray:
        """By block, as are ``gradients`` and ``hessians``."""
        return -0.5 * (self.view.sums(np.full(len(self.pz), np.log(2 * np.pi)) + self.pz * self.b) + self.logdets)

    def likelihood(self) -> float:
        return float(self.likelihoods().sum())

    def node_gradient(self, method: str = "exact", **probes: int) -> np.ndarray:
        return -0.5 * (inverse_diagonal(self.view, method, **probes) - self.b**2)

    def node_hessian(self, method: str = "exact", **probes: int) -> np.ndarray:
        """Average information of each node alone."""
        return -0.5 * inverse_diagonal(self.view, method, **probes) * self.b**2

    def gradients(self, dm: np.ndarray, method: str = "exact", **probes: int) -> np.ndarray:
        """For parameters whose change of M's diagonal are the columns of ``dm``."""
        by_node = self.node_gradient(method, **probes)
        return np.stack([self.view.sums(by_node * d) for d in dm.T], 1)

    def gradient(self, dm: np.ndarray, method: str = "exact", **probes: int) -> np.ndarray:
        return self.gradients(dm, method, **probes).sum(0)

    def hessians(self, dm: np.ndarray) -> np.ndarray:
        """Average information: -1/2 (dM b)' M^-1 (dM b)."""
        x = dm * self.b[:, None]
        y = self.view.solve(x)
        if len(self.view.p.starts) == 1:
            return -0.5 * (x.T @ y)[None]
        return -0.5 * np.stack([np.stack([self.view.sums(a * b) for b in y.T], 1) for a in x.T], 1)

    def hessian(self, dm: np.ndarray) -> np.ndarray:
        return self.hessians(dm).sum(0)


def likelihood(m: np.ndarray, pz: np.ndarray) -> float:
    return Gaussian(m, pz).likelihood()


def likelihood_gradient(m: np.ndarray, pz: np.ndarray, dm: np.ndarray) -> np.ndarray:
    return Gaussian(m, pz).gradient(dm)


def likelihood_hessian(m: np.ndarray, pz: np.ndarray, dm: np.ndarray) -> np.ndarray:
    return Gaussian(m, pz).hessian(dm)


def partial_likelihood(p: Sparse | np.ndarray, pz: np.ndarray, sigma2: np.ndarray, seen: np.ndarray, n: float, intercept: float = 1.0) -> tuple[float, np.ndarray, float]:
    """Likelihood of the seen nodes' Pz / sqrt(N), with its gradients for each sigma2 and for the intercept.

    ``sigma2`` has a value for every node. M = intercept / N P + diag(sigma2) loses the unseen nodes as P does: by its Schur complement, whose
    determinant is that of the whole by that of the unseen part, and whose inverse is a part of the whole's. An intercept below zero has likelihood -inf.
    """
    if intercept < 0:
        return -np.inf, np.zeros(len(sigma2)), 0.0
    p = Sparse.of(p)
    whole = p.scaled(intercept / n).with_diagonal(np.arange(p.n), sigma2)
    g = Gaussian(whole, pz, seen)
    by_node = whole.factor.inverse_diagonal - g.full**2
    change = (_trace(whole, p) - g.full @ p.multiply(g.full)) / n
    if len(g.view.rest):
        rest = g.view.others
        by_node[g.view.rest] -= rest.factor.inverse_diagonal
        change -= _trace(rest, p.take(g.view.rest)) / n
    return g.likelihood(), -0.5 * by_node, float(-0.5 * change)


def _trace(m: Sparse, p: Sparse) -> float:
    """Trace of M^-1 P, where P has no entry that M lacks."""
    at = np.searchsorted(m.i * m.n + m.j, p.i * p.n + p.j)
    return float(m.factor.inverse_entries[at] @ p.value)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def impute(p: Sparse | np.ndarray, nodes: np.ndarray, z: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Z of nodes that lack one, expected from those that have it: -P_uu^-1 P_us z_s, all other nodes of the block among u; seen ones stay."""
    p = Sparse.of(p)
    known = np.zeros(p.n)
    known[nodes[seen]] = z[seen]
    rest = np.setdiff1d(np.arange(p.n), nodes[seen])
    out = known.copy()
    out[rest] = -p.take(rest).factor.solve(p.multiply(known)[rest])
    return np.where(seen, z, out[nodes])


def halves_chi2(p: Sparse | np.ndarray, nodes: np.ndarray, z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chi-square of each variant against its prediction from the other half: given that half, the others' covariance is P_uu^-1."""
    p, out = Sparse.of(p), np.zeros(len(z))
    for own in (first, ~first):
        known = np.zeros(p.n)
        known[nodes[~own]] = z[~own]
        rest = np.setdiff1d(np.arange(p.n), nodes[~own])
        factor, place = p.take(rest).factor, np.searchsorted(rest, nodes[own])
        expected = -factor.solve(p.multiply(known)[rest])[place]
        out[own] = (z[own] - expected) ** 2 / np.maximum(1e-12, factor.inverse_diagonal[place])
    return out


def regularise(p: Sparse | np.ndarray, nodes: np.ndarray, z: np.ndarray, strength: float) -> np.ndarray:
    """R ((1 - s) R + s I)^-1 z = (s P + (1 - s) I)^-1 z for a view of P."""
    if not strength:
        return z
    return solve(Sparse.of(p).scaled(strength).with_diagonal(nodes, 1 - strength), z, nodes)


def lasso_precision(c: np.ndarray, support: np.ndarray, penalty: float = 0.0, sweeps: int = 25, tolerance: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """Precision matrix on a support from correlations ``c``: coordinate descent on the penalised likelihood, from the diagonal or from ``start``.

    An entry moves to the minimiser of its quadratic model, halved until the determinant stays positive and
    the objective falls. The inverse is kept up to date by rank-two updates, so a step costs n * n. A start that is not positive definite is
    mended first: its diagonal is raised until it is. Of a stack of matrices (all arguments are then stacks) each goes its own way, one entry of all at a time.
    """
    if c.ndim == 2:
        return lasso_precision(c[None], support[None], penalty, sweeps, tolerance, None if start is None else start[None])[0]
    n = c.shape[1]
    unit = np.eye(n)
    p = unit / np.diagonal(c, axis1=1, axis2=2)[:, :, None] if start is None else np.stack([mended(x) for x in start])
    w = np.linalg.inv(p)
    pairs = np.argwhere(np.triu(support.any(0) | np.eye(n, dtype=bool)))
    on = np.arange(len(c))  # matrices that still move
    for _ in range(sweeps):
        moved, kept = np.zeros(len(c)), p[on]
        for i, j in pairs:
            diagonal = i == j
            k = on if diagonal else on[support[on, i, j]]
            wij, wii, wjj, cij, pij = w[k, i, j], w[k, i, i], w[k, j, j], c[k, i, j], p[k, i, j]
            h = wii**2 if diagonal else wij**2 + wii * wjj
            target = pij - (cij - wij) / h
            if not diagonal and penalty:
                target = np.sign(target) * np.maximum(0.0, np.abs(target) - penalty / h)
            step, grown = target - pij, np.ones(len(k))
            tried = np.flatnonzero(np.abs(step) > tolerance)
            while len(tried):
                s, t = step[tried], tried
                grown[t] = 1 + s * wii[t] if diagonal else (1 + s * wij[t]) ** 2 - s**2 * wii[t] * wjj[t]
                change = (1 if diagonal else 2) * (s * cij[t]) - np.log(np.where(grown[t] > 0, grown[t], 1.0)) + (0 if diagonal else 2 * penalty * (np.abs(pij[t] + s) - np.abs(pij[t])))
                tried = t[~((grown[t] > 0) & (change < 0))]
                step[tried] /= 2
                tried = tried[np.abs(step[tried]) > tolerance]
            far = np.abs(step) > tolerance
            k, step, grown = k[far], step[far], grown[far]
            if not len(k):
                continue
            p[k, i, j] = p[k, j, i] = p[k, i, j] + step
            if diagonal:
                w[k] -= (step / grown)[:, None, None] * (w[k, :, i, None] * w[k, i, None, :])
            else:
                a = w[k][:, :, [i, j]]
                corner = np.stack([np.stack([w[k, i, i], w[k, i, j] + 1 / step], 1), np.stack([w[k, i, j] + 1 / step, w[k, j, j]], 1)], 1)
                w[k] -= a @ np.linalg.solve(corner, a.transpose(0, 2, 1))
            moved[k] = np.maximum(moved[k], np.abs(step))
        fine = positive_definite_each(p[on])
        p[on[~fine]] = kept[~fine]  # rounding has carried the updates away
        on = on[fine]
        w[on] = np.linalg.inv(p[on])
        on = on[moved[on] >= tolerance]
        if not len(on):
            break
    return p


def positive_definite_each(p: np.ndarray) -> np.ndarray:
    return np.ones(len(p), bool) if positive_definite(p) else np.array([positive_definite(x) for x in p])


def positive_definite(p: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        return False
    return True


def mended(p: np.ndarray) -> np.ndarray:
    """The matrix with its diagonal raised, by doubling shares of its mean, until it is positive definite."""
    out, share = p.copy(), 1e-6
    while not positive_definite(out):
        out = p + share * np.mean(np.abs(np.diag(p))) * np.eye(len(p))
        share *= 2
    return out


def two_phase_precision(c: np.ndarray, support: np.ndarray, penalty: float = 0.1, penalised: int = 5, free: int = 25) -> np.ndarray:
    """Edges are chosen on the support by a few penalised sweeps and estimated without the penalty from there."""
    chosen = lasso_precision(c, support, penalty, penalised)
    return lasso_precision(c, chosen != 0, 0.0, free, start=chosen)
