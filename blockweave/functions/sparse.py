"""Sparse symmetric matrices of blocks and their factors: what lets a block of thousands of nodes, or thousands of small blocks, be solved in a task.

A factor follows a nested dissection of the matrix's graph. A part (a separator, or a small rest) is eliminated after all parts that it
separates; it holds a dense front over its own nodes and those later ones that it touches, so arrays are as large as fronts,
never as the block. Positive definiteness isn't needed as long as no front's own corner is singular.

Small blocks are pooled: a matrix may hold many that no entry ties, and its factor the inverses of those of one size as one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: Nodes of a part that is not dissected further.
LEAF = 48


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of count[0] numbers, then those of start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


class Sparse:
    """A symmetric matrix from entries of both triangles; duplicates add up. A pool of blocks has the first node of each in ``starts``."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray, starts: np.ndarray | None = None):
        key, at = np.unique(np.asarray(i, np.int64) * n + np.asarray(j, np.int64), return_inverse=True)
        self.n, self.i, self.j = n, key // max(n, 1), key % max(n, 1)
        self.value = np.bincount(at, np.asarray(value, float), len(key)) if len(key) else np.zeros(0)
        self.start = np.searchsorted(self.i, np.arange(n + 1))
        self.starts = np.zeros(1, np.int64) if starts is None else starts

    @staticmethod
    def of(p: Sparse | np.ndarray) -> Sparse:
        if isinstance(p, Sparse):
            return p
        p = np.asarray(p, float)
        i, j = np.nonzero(p)
        return Sparse(len(p), i, j, p[i, j])

    def __len__(self) -> int:
        return self.n

    def multiply(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 1:
            return np.bincount(self.i, self.value * x[self.j], self.n) if self.n else np.zeros(0)
        return np.stack([self.multiply(c) for c in x.T], 1) if x.shape[1] else np.zeros((self.n, 0))

    def scaled(self, factor: float) -> Sparse:
        return Sparse(self.n, self.i, self.j, self.value * factor, self.starts)

    def with_diagonal(self, at: np.ndarray, value: np.ndarray | float) -> Sparse:
        """This matrix with ``value`` added on the diagonal at some nodes."""
        at = np.asarray(at, np.int64)
        return Sparse(self.n, np.concatenate([self.i, at]), np.concatenate([self.j, at]), np.concatenate([self.value, np.broadcast_to(value, len(at))]), self.starts)

    def take(self, keep: np.ndarray) -> Sparse:
        """Rows and columns of some nodes, numbered in the order given; for a pool they ascend."""
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        inside = (place[self.i] >= 0) & (place[self.j] >= 0)
        return Sparse(len(keep), place[self.i[inside]], place[self.j[inside]], self.value[inside], np.searchsorted(keep, self.starts) if len(self.starts) > 1 else None)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[self.i, self.j] = self.value
        return out

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        """Columns of all entries in the rows of ``nodes``, with repeats."""
        return self.j[_ranges(self.start[nodes], self.start[nodes + 1] - self.start[nodes])]

    @cached_property
    def factor(self) -> Factor | Stacks:
        return Factor(self) if len(self.starts) == 1 else Stacks(self)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Nodes of each block."""
        return np.diff(np.append(self.starts, self.n))

    @cached_property
    def block(self) -> np.ndarray:
        """The block of each node."""
        return np.repeat(np.arange(len(self.starts)), self.sizes)

    @property
    def local(self) -> np.ndarray:
        """The number of each node in its block."""
        return np.arange(self.n) - self.starts[self.block]

    def stacks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of one size: their numbers, their nodes (a row a block) and their matrices."""
        own = self.block[self.i]
        for m in np.unique(self.sizes[self.sizes > 0]):
            which = np.flatnonzero(self.sizes == m)
            place = np.zeros(len(self.sizes), np.int64)
            place[which] = np.arange(len(which))
            at = np.flatnonzero(self.sizes[own] == m)
            matrices = np.zeros((len(which), m, m))
            matrices[place[own[at]], self.j[at] - self.starts[own[at]], self.i[at] - self.starts[own[at]]] = self.value[at]
            yield which, self.starts[which][:, None] + np.arange(m), matrices

    @cached_property
    def diagonal(self) -> np.ndarray:
        out = np.zeros(self.n)
        on = self.i == self.j
        out[self.i[on]] = self.value[on]
        return out


def levels(p: Sparse, first: int, region: np.ndarray, token: int) -> list[np.ndarray]:
    """Breadth-first levels from a node within a region (where ``region`` is ``token``), whose nodes are marked -token when reached."""
    out, now = [], np.array([first])
    region[first] = -token
    while len(now):
        out.append(now)
        near = np.unique(p.neighbours(now))
        now = near[region[near] == token]
        region[now] = -token
    return out


def dissection(p: Sparse) -> tuple[list[np.ndarray], list[int]]:
    """Parts and the part above each (-1: none); a part's entries lie in itself, in parts below it and in parts above it.

    A level separates all levels before it from all behind it, so a region is cut along one set of levels again and again; levels are
    found anew only where a region is down to two of them.
    """
    parts: list[np.ndarray] = []
    above: list[int] = []
    region, token = np.zeros(p.n, np.int64), 0
    todo: list[tuple[list[np.ndarray], int]] = [([np.arange(p.n)], -1)]

    def add(nodes: np.ndarray, top: int) -> int:
        parts.append(nodes)
        above.append(top)
        return len(parts) - 1

    while todo:
        rings, top = todo.pop()
        size = sum(map(len, rings))
        if size <= LEAF:
            if size:
                add(np.concatenate(rings), top)
            continue
        if len(rings) < 3:
            nodes = np.concatenate(rings)
            token += 1
            region[nodes] = token
            found = [levels(p, int(first), region, token) for first in nodes if region[first] == token]
            if len(found) > 1:  # separate already; small pieces are put together
                batch: list[np.ndarray] = []
                for piece in found:
                    if sum(map(len, piece)) > LEAF:
                        todo.append(([np.concatenate(piece)], top))
                        continue
                    batch.append(np.concatenate(piece))
                    if sum(map(len, batch)) > LEAF // 2:
                        add(np.concatenate(batch), top)
                        batch = []
                if batch:
                    add(np.concatenate(batch), top)
                continue
            token += 1
            region[nodes] = token
            rings = levels(p, int(found[0][-1][0]), region, token)  # from the far end
            if len(rings) < 3:  # every node is near every other
                add(nodes, top)
                continue
        upto = np.cumsum([len(r) for r in rings])
        middle = [k for k in range(1, len(rings) - 1) if 0.25 * size <= upto[k - 1] and upto[k] <= 0.75 * size] or range(1, len(rings) - 1)
        at = min(middle, key=lambda k: len(rings[k]) + 0.1 * abs(upto[k] - size / 2))
        here = add(np.sort(rings[at]), top)
        todo += [(rings[:at], here), (rings[at + 1 :], here)]
    return parts, above


class Factor:
    """Fronts of a matrix: for each part its own nodes, the later ones it touches, the inverse of its corner and the multipliers."""

    def __init__(self, p: Sparse):
        self.p = p
        self.parts, self.above = dissection(p)
        self.order = range(len(self.parts) - 1, -1, -1)  # a part comes after the one above it, so this goes from the leaves up
        rank = np.empty(p.n, np.int64)
        for k, own in enumerate(self.parts):
            rank[own] = -k
        self.rank = rank
        self.edge: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.parts)
        self.corner: list[np.ndarray] = [np.zeros((0, 0))] * len(self.parts)
        self.multiplier: list[np.ndarray] = [np.zeros((0, 0))] * len(self.parts)
        self.logdet = 0.0
        below: list[list[int]] = [[] for _ in self.parts]
        for k, top in enumerate(self.above):
            if top >= 0:
                below[top].append(k)
        place, rest = np.zeros(p.n, np.int64), {}
        for k in self.order:
            own = self.parts[k]
            near = np.unique(np.concatenate([p.neighbours(own), *(self.edge[c] for c in below[k])]))
            edge = near[rank[near] > -k]
            nodes, m = np.concatenate([own, edge]), len(own)
            place[nodes] = np.arange(len(nodes))
            front = np.zeros((len(nodes), len(nodes)))
            at = _ranges(p.start[own], p.start[own + 1] - p.start[own])
            at = at[rank[p.j[at]] >= -k]
            front[place[p.j[at]], place[p.i[at]]] = p.value[at]
            front[:m, m:] = front[m:, :m].T
            for c in below[k]:
                to = place[self.edge[c]]
                front[np.ix_(to, to)] += rest.pop(c)
            sign, log = np.linalg.slogdet(front[:m, :m])
            if sign == 0 or not np.isfinite(log):
                raise np.linalg.LinAlgError("the matrix is singular")
            self.logdet += float(log)
            self.edge[k], self.corner[k] = edge, np.linalg.inv(front[:m, :m])
            self.multiplier[k] = front[m:, :m] @ self.corner[k]
            if len(edge):
                rest[k] = front[m:, m:] - self.multiplier[k] @ front[:m, m:]

    @property
    def logdets(self) -> np.ndarray:
        return np.array([self.logdet])

    @property
    def entries(self) -> int:
        """Numbers that the factor holds."""
        return sum(c.size + m.size for c, m in zip(self.corner, self.multiplier, strict=True))

    def _up(self, x: np.ndarray, parts: range | list[int]) -> None:
        for k in parts:
            if len(self.edge[k]):
                x[self.edge[k]] -= self.multiplier[k] @ x[self.parts[k]]

    def _down(self, x: np.ndarray, parts: range | list[int]) -> None:
        for k in reversed(parts):
            own = self.parts[k]
            x[own] = self.corner[k] @ x[own]
            if len(self.edge[k]):
                x[own] -= self.multiplier[k].T @ x[self.edge[k]]

    def solve(self, b: np.ndarray) -> np.ndarray:
        """P^-1 b for a vector or for columns."""
        x = np.array(b, float)
        self._up(x, self.order)
        self._down(x, self.order)
        return x

    def _path(self, nodes: np.ndarray) -> list[int]:
        """The parts of some nodes and all parts above these, from the leaves up."""
        seen: set[int] = set()
        for k in np.unique(-self.rank[nodes]).tolist():
            while k >= 0 and k not in seen:
                seen.add(k)
                k = self.above[k]
        return sorted(seen, reverse=True)

    def column(self, node: int | np.ndarray) -> np.ndarray:
        """A column of P^-1."""
        x = np.zeros(self.p.n)
        x[node] = 1.0
        self._up(x, self._path(np.atleast_1d(node)))
        self._down(x, self.order)
        return x

    def solve_at(self, b: np.ndarray, active: np.ndarray) -> np.ndarray:
        """P^-1 b at some nodes, where b is zero at all others: only the parts above these nodes are visited."""
        on = self._path(active)
        x = np.zeros((self.p.n, *np.shape(b)[1:]))
        x[active] = b
        self._up(x, on)
        self._down(x, on)
        return x[active]

    def noise(self, b: np.ndarray) -> np.ndarray:
        """Normal draws with covariance P^-1 from independent ones; P is positive definite."""
        x = np.array(b, float)
        for k in reversed(self.order):
            own = self.parts[k]
            half = np.linalg.cholesky((self.corner[k] + self.corner[k].T) / 2)
            x[own] = half @ x[own]
            if len(self.edge[k]):
                x[own] -= self.multiplier[k].T @ x[self.edge[k]]
        return x

    @cached_property
    def inverse_entries(self) -> np.ndarray:
        """Entries of P^-1 at the places of P's own entries, in their order; the diagonal is in ``inverse_diagonal``."""
        p, place, fronts = self.p, np.zeros(self.p.n, np.int64), {}
        out, self._diagonal = np.zeros(len(p.value)), np.zeros(p.n)
        children = [0] * len(self.parts)
        for top in self.above:
            if top >= 0:
                children[top] += 1
        for k in reversed(self.order):
            own, edge, m = self.parts[k], self.edge[k], len(self.parts[k])
            nodes = np.concatenate([own, edge])
            z = np.zeros((len(nodes), len(nodes)))
            if len(edge):
                known_nodes, known = fronts[self.above[k]]
                place[known_nodes] = np.arange(len(known_nodes))
                at = place[edge]
                z[m:, m:] = known[np.ix_(at, at)]
                z[m:, :m] = -z[m:, m:] @ self.multiplier[k]
                z[:m, m:] = z[m:, :m].T
            z[:m, :m] = self.corner[k] - (self.multiplier[k].T @ z[m:, :m] if len(edge) else 0)
            self._diagonal[own] = np.diag(z)[:m]
            place[nodes] = np.arange(len(nodes))
            at = _ranges(p.start[own], p.start[own + 1] - p.start[own])
            at = at[self.rank[p.j[at]] >= -k]
            out[at] = z[place[p.i[at]], place[p.j[at]]]
            if children[k]:
                fronts[k] = (nodes, z)
            top = self.above[k]
            if top >= 0:
                children[top] -= 1
                if not children[top]:
                    del fronts[top]
        early = self.rank[p.j] < self.rank[p.i]  # their mirror image was filled
        mirror = np.searchsorted(p.i * p.n + p.j, p.j[early] * p.n + p.i[early])
        out[early] = out[mirror]
        return out

    @property
    def inverse_diagonal(self) -> np.ndarray:
        self.inverse_entries  # noqa: B018  fills the diagonal
        return self._diagonal


class Stacks:
    """Inverses of a pool of small blocks, those of one size as one array: what ``Factor`` gives of one block, of all at once."""

    def __init__(self, p: Sparse):
        self.p, self.logdets = p, np.zeros(len(p.starts))
        self.inverses: list[tuple[np.ndarray, np.ndarray]] = []
        for which, nodes, matrices in p.stacks():
            sign, log = np.linalg.slogdet(matrices)
            if not (sign.all() and np.isfinite(log).all()):
                raise np.linalg.LinAlgError("the matrix is singular")
            self.logdets[which] = log
            self.inverses.append((nodes, np.linalg.inv(matrices)))

    @property
    def logdet(self) -> float:
        return float(self.logdets.sum())

    def _each(self, b: np.ndarray, halves: bool = False) -> np.ndarray:
        """Every block's inverse, or the lower half of its Cholesky factors, times its part of a vector or of columns."""
        b = np.asarray(b, float)
        x = np.zeros_like(b)
        for nodes, m in self.inverses:
            m = np.linalg.cholesky((m + m.transpose(0, 2, 1)) / 2) if halves else m
            x[nodes] = (m @ b[nodes].reshape(*nodes.shape, -1)).reshape(*nodes.shape, *b.shape[1:])
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        """P^-1 b for a vector or for columns."""
        return self._each(b)

    def column(self, node: np.ndarray) -> np.ndarray:
        """Columns of P^-1, one in each of some blocks, as one vector; zeros in the other blocks."""
        x = np.zeros(self.p.n)
        x[node] = 1.0
        return self._each(x)

    def solve_at(self, b: np.ndarray, active: np.ndarray) -> np.ndarray:
        """P^-1 b at some nodes, where b is zero at all others."""
        x = np.zeros((self.p.n, *np.shape(b)[1:]))
        x[active] = b
        return self._each(x)[active]

    def noise(self, b: np.ndarray) -> np.ndarray:
        """Normal draws with covariance P^-1 from independent ones; P is positive definite."""
        return self._each(b, halves=True)

    @cached_property
    def inverse_diagonal(self) -> np.ndarray:
        out = np.zeros(self.p.n)
        for nodes, m in self.inverses:
            out[nodes] = np.diagonal(m, axis1=1, axis2=2)
        return out
