"""Block-wise linear algebra: matrices as rows (block_id, i, j, value), vectors as (block_id, i, x).

Sums and full products are joins and aggregates. What needs a factorisation gets a block's entries and rows in one row of arrays
(``packed``), many such rows a task, and works on the block's sparse factor; the block catalog bounds a block's size. Blocks that
are too small to be dissected are pooled, so that a kernel is called for thousands of them at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockweave.functions import kernels
from blockweave.functions.sparse import LEAF, Sparse, _ranges
from blockweave.operators.lineage import cut

Kernel = Callable[[Sparse, pd.DataFrame], pd.DataFrame]
#: Rows of results that a task gathers before it hands them on.
RESULT_ROWS = 20_000
#: Nodes of a pool of small blocks.
POOL_NODES = 20_000


def sparse_precision(edges: DataFrame, symmetric: bool = True) -> DataFrame:
    """Entries of P from edges (block_id, i, j, value): duplicates add up, off-diagonals are mirrored.

    Both directions of an edge are one sum, which is mirrored after it: edges are read and shuffled once.
    """
    if not symmetric:
        return edges.groupBy("block_id", "i", "j").agg(F.sum("value").alias("value"))
    turned = F.col("i") > F.col("j")
    upper = edges.select("block_id", F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("j"), "value")
    summed = upper.groupBy("block_id", "i", "j").agg(F.sum("value").alias("value"))
    entry, mirrored = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return summed.select("block_id", F.explode(F.when(F.col("i") != F.col("j"), F.array(entry, mirrored)).otherwise(F.array(entry))).alias("at"), "value").select("block_id", "at.i", "at.j", "value")


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """P x for all blocks."""
    x = vector.select("block_id", F.col("i").alias("j"), "x")
    return matrix.join(x, ["block_id", "j"]).groupBy("block_id", "i").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def scale(matrix: DataFrame, factor: float) -> DataFrame:
    return matrix.withColumn("value", F.col("value") * F.lit(float(factor)))


def update_diagonal(matrix: DataFrame, update: DataFrame) -> DataFrame:
    """P with (block_id, i, x) added to its diagonal, which must stay positive."""
    added = update.select("block_id", "i", F.col("i").alias("j"), F.col("x").alias("value"))
    out = matrix.unionByName(added).groupBy("block_id", "i", "j").agg(F.sum("value").alias("value"))
    good = F.when(F.col("i") == F.col("j"), F.when(F.col("value") > 0, F.col("value")).otherwise(F.raise_error(F.lit("a diagonal entry is not positive")).cast("double"))).otherwise(F.col("value"))
    return out.withColumn("value", good)


def node_sums(values: DataFrame) -> DataFrame:
    """Values of variants (block_id, i, x) added up by node."""
    return values.groupBy("block_id", "i").agg(F.sum("x").alias("x"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows by block_id over twice the shuffle partitions, as blocks are unequal.

    The number is stated, as Spark would merge partitions that are small in bytes, and a block's work grows faster than its bytes: a thousand
    blocks of a megabyte would end in some twenty tasks. It differs from that of other shuffles, or a merged one by block_id would be taken for it.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block_id")


def packed(matrix: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row a block that has rows: block_id, ``entries`` of its matrix (null without any) and its ``rows``, as arrays of structs.

    Without ``rows`` every block of the matrix has one, which holds its block_id. Both sides are dealt by block_id before they are grouped
    and joined, so neither is shuffled again, and a table that is kept packed isn't either.
    """
    entries = dealt(matrix.select("block_id", "i", "j", "value")).groupBy("block_id").agg(F.collect_list(F.struct("i", "j", "value")).alias("entries"))
    if rows is None:
        return entries.select("block_id", F.array(F.struct("block_id")).alias("rows"), "entries")
    own = dealt(rows.select(*[F.col(c).alias(c) for c in rows.columns]))  # both sides may stem from one table
    return own.groupBy("block_id").agg(F.collect_list(F.struct(*own.columns)).alias("rows")).join(entries, "block_id", "left")


def arrays_of(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat fields of an array of structs."""
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    return offsets, {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(flat.type, flat.flatten(), strict=True)}


class Matrices:
    """The matrices of a packed batch."""

    def __init__(self, batch: pa.RecordBatch):
        self.at, self.entry = arrays_of(batch.column("entries"))
        self.count = np.diff(self.at)
        self.size = np.zeros(batch.num_rows, np.int64)
        full = self.count > 0
        if full.any():
            self.size[full] = np.maximum.reduceat(np.maximum(self.entry["i"], self.entry["j"]), self.at[:-1][full]) + 1

    def pools(self, at: np.ndarray, node: np.ndarray, together: bool = True) -> list[np.ndarray]:
        """Numbers of the blocks that go into one matrix: small ones up to POOL_NODES, each other one alone; so does a block that lacks a node among those that its rows name."""
        owner = np.repeat(np.arange(len(self.size)), np.diff(at))
        outside = np.bincount(owner, ~((node >= 0) & (node < self.size[owner])), len(self.size)) > 0
        small = (self.size > 0) & (self.size <= LEAF) & ~outside & together
        many = np.flatnonzero(small)
        cuts = np.flatnonzero(np.diff(np.cumsum(self.size[many]) // POOL_NODES)) + 1
        return [x for x in np.split(many, cuts) if len(x)] + [np.array([k]) for k in np.flatnonzero(~small)]

    def of(self, which: np.ndarray) -> Sparse:
        size, count = self.size[which], self.count[which]
        starts = np.cumsum(size) - size
        e, shift = _ranges(self.at[which], count), np.repeat(starts, count)
        return Sparse(int(size.sum()), self.entry["i"][e] + shift, self.entry["j"][e] + shift, self.entry["value"][e], starts)


def pools_of(batch: pa.RecordBatch, together: bool = True) -> Iterator[tuple[np.ndarray, Sparse, pd.DataFrame]]:
    """The blocks of a packed batch, as pools: their numbers in the batch, their matrix and their rows, which get ``_block``, the number
    of their block in the pool, and ``_node``, the number of their node (``i``) there. Without ``together`` each block is alone."""
    matrices = Matrices(batch)
    row_at, row = arrays_of(batch.column("rows"))
    for which in matrices.pools(row_at if "i" in row else np.zeros_like(row_at), row.get("i", np.zeros(0, np.int64)), together):
        p, count = matrices.of(which), np.diff(row_at)[which]
        r = _ranges(row_at[which], count)
        v = pd.DataFrame({c: x[r] for c, x in row.items()} | {"_block": np.repeat(np.arange(len(which)), count)})
        if "i" in row:
            v["_node"] = v["i"] + p.starts[v["_block"]]
        yield which, p, v


def names_of(v: pd.DataFrame) -> np.ndarray:
    """The block_id of each block of a pool."""
    return v["block_id"].to_numpy()[np.unique(v["_block"].to_numpy(), return_index=True)[1]]


def map_blocks(blocks: DataFrame, kernel: Kernel, schema: str, together: bool = True) -> DataFrame:
    """Run ``kernel(P, rows)`` on every pool of blocks of a packed table (see ``pools_of``)."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def results(batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        for which, p, rows in pools_of(batch, together):
            try:
                yield kernel(p, rows)
            except np.linalg.LinAlgError:  # of a block that alone may need no factor
                if len(which) == 1:
                    raise
                for _, q, own in pools_of(batch.take(pa.array(which)), False):
                    yield kernel(q, own)

    def joined(found: list[pd.DataFrame]) -> pa.RecordBatch:
        """Many small results as one batch."""
        columns = [np.concatenate([f[n].to_numpy() for f in found]) for n in arrow.names]
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for out in results(batch):
                if len(out):
                    found.append(out)
                    n += len(out)
                if n >= RESULT_ROWS:
                    yield joined(found)
                    found, n = [], 0
            if found:
                yield joined(found)

    return blocks.mapInArrow(run, schema)


def per_block(matrix: DataFrame, rows: DataFrame | None, kernel: Kernel, schema: str, together: bool = True) -> DataFrame:
    """Run ``kernel(P, rows)`` on every block that has rows (see ``packed``), on small ones in pools; a block without entries has an empty P."""
    return map_blocks(packed(matrix, rows), kernel, schema, together)


def solve(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """R b of every block; nodes without a row have b = 0 and no result."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("_node", ignore_index=True)
        v["y"] = kernels.solve(p, v["x"].to_numpy(), v["_node"].to_numpy())
        return v[["block_id", "i", "y"]]

    return per_block(matrix, vector, kernel, "block_id string, i int, y double")


def variant_solve(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """Sums by node, solves, and gives each variant (block_id, i, variant, x) its node's result."""
    return values.join(solve(matrix, node_sums(values)), ["block_id", "i"]).select("block_id", "variant", "i", "y")


def select_nodes(selection: DataFrame, chosen: DataFrame) -> DataFrame:
    """A view of a view: ``chosen`` (block_id, at, ord) are places in ``selection`` (block_id, i, ord); repeated ones count once.

    Views are tables of node numbers; nothing is computed until a product, a solve or a determinant asks for it.
    """
    first = chosen.groupBy("block_id", "at").agg(F.min("ord").alias("ord"))
    own = selection.select("block_id", "i", F.col("ord").alias("at"))
    return own.join(first, ["block_id", "at"]).withColumn("ord", (F.row_number().over(Window.partitionBy("block_id").orderBy("ord")) - 1).cast("int")).select("block_id", "i", "ord")


def select_where(selection: DataFrame, condition: Column | str) -> DataFrame:
    """A view of the nodes for which a condition on (i, ord) holds."""
    return selection.where(condition).withColumn("ord", (F.row_number().over(Window.partitionBy("block_id").orderBy("ord")) - 1).cast("int"))


def _view(matrix: DataFrame, selection: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    return per_block(matrix, selection, lambda p, v: kernel(p, v.sort_values(["_block", "ord"], ignore_index=True)), schema)


def selected_matrix(matrix: DataFrame, selection: DataFrame) -> DataFrame:
    """Entries (block_id, i, j, value) of a view's matrix, by place in the view."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        found, view, names = [], kernels.View(p, v["_node"].to_numpy()), v["block_id"].to_numpy()
        for first, m in view.columns():
            i, j = np.nonzero(m)
            found.append(pd.DataFrame({"block_id": names[i], "i": view.rank[i], "j": j + first, "value": m[i, j]}))
        return pd.concat(found)

    return _view(matrix, selection, kernel, "block_id string, i int, j int, value double")


def selected_multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """P_view x for views whose rows carry x: (block_id, i, ord, x)."""
    kernel = lambda p, v: v[["block_id", "i", "ord"]].assign(y=kernels.multiply(p, v["x"].to_numpy(), v["_node"].to_numpy()))
    return _view(matrix, vector, kernel, "block_id string, i int, ord int, y double")


def selected_log_determinant(matrix: DataFrame, selection: DataFrame) -> DataFrame:
    kernel = lambda p, v: pd.DataFrame({"block_id": names_of(v), "logdet": kernels.View(p, v["_node"].to_numpy()).logdets})
    return _view(matrix, selection, kernel, "block_id string, logdet double")


def normalise(matrix: DataFrame) -> DataFrame:
    """Matrices scaled on both sides so that their inverses have a diagonal of ones, each in its block's task."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        y = kernels.inverse_diagonal(p)
        return pd.DataFrame({"block_id": names_of(v)[p.block[p.i]], "i": p.local[p.i], "j": p.local[p.j], "value": p.value, "y": y[p.i], "other": y[p.j]})

    found = per_block(matrix, None, kernel, "block_id string, i int, j int, value double, y double, other double")
    return found.select("block_id", "i", "j", (F.col("value") * F.sqrt("y") * F.sqrt("other")).alias("value"))


def inverse_diagonal(matrix: DataFrame, method: str = "exact", n_samples: int = 100, seed: int = 0) -> DataFrame:
    """Diagonal of R, exact or estimated; probes are a function of the seed and the block."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        y = kernels.inverse_diagonal(p, method, n_samples=n_samples, seed=block_seed(seed, v["block_id"].iloc[0]))
        return pd.DataFrame({"block_id": names_of(v)[p.block], "i": p.local, "y": y})

    return per_block(matrix, None, kernel, "block_id string, i int, y double", together=method == "exact")  # a block has its own probes


def log_determinant(matrix: DataFrame) -> DataFrame:
    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block_id": names_of(v), "logdet": kernels.View(p).logdets})

    return per_block(matrix, None, kernel, "block_id string, logdet double")


def blup(matrix: DataFrame, rows: DataFrame, sigma2: float) -> DataFrame:
    """Weights of merged rows (block_id, i, z, n, is_representative); rows that represent no node have 0."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        z, weight = v["z"].to_numpy(float), np.zeros(len(v))
        rep = v["is_representative"].to_numpy(bool) & ~np.isnan(z)
        if rep.any() and len(p):
            block = v["_block"].to_numpy()
            n = np.bincount(block, v["n"].to_numpy(float)) / np.bincount(block)
            weight[rep] = kernels.blup(p, z[rep], n[block[rep]], sigma2, v["_node"].to_numpy()[rep])
        return pd.DataFrame({"block_id": v["block_id"].to_numpy(), "row_nr": v["row_nr"].to_numpy(), "weight": weight})

    return per_block(matrix, rows, kernel, "block_id string, row_nr long, weight double")


def clump(matrix: DataFrame, rows: DataFrame, rsq: float = 0.1, chi2: float = 30.0) -> DataFrame:
    """Lead flags of merged rows; rows that represent no node are no leads."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort([v["row_nr"].to_numpy(), v["_node"].to_numpy()])  # ties in chi-square go to the smaller node
        z, i, lead = v["z"].to_numpy(float)[order], v["_node"].to_numpy()[order], np.zeros(len(v), bool)
        rep = v["is_representative"].to_numpy(bool)[order] & ~np.isnan(z)
        if rep.any() and len(p):
            lead[rep] = kernels.clump(p, z[rep], i[rep], rsq, chi2)
        return pd.DataFrame({"block_id": v["block_id"].to_numpy()[order], "row_nr": v["row_nr"].to_numpy()[order], "is_index": lead})

    return per_block(matrix, rows, kernel, "block_id string, row_nr long, is_index boolean")


def _lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists of consecutive values, from their offsets."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


REML_STATE = "block_id string, block_nr long, entries array<struct<i: int, j: int, value: double>>, nodes array<int>, pz array<double>, rest_logdet double, place array<int>, row_nr array<long>, annotations array<double>"


def reml_state(matrix: DataFrame, rows: DataFrame, annotations: list[str], sample_size: float, blocks: DataFrame | None = None) -> DataFrame:
    """What the evaluations of a likelihood need of each block and what no parameter changes: one row a block, the columns of REML_STATE.

    rows: block_id, row_nr, i, z, annotations. ``blocks`` (block_id, block_nr) is the catalog's order, in which blocks without rows stay;
    without it blocks are numbered by the first row_nr in them. ``pz`` is the product of the view of nodes with rows and their Z, by the root
    of the sample size; ``rest_logdet`` the log determinant of the other nodes' part of P.
    """
    def kernel(p: Sparse, v: pd.DataFrame) -> dict[str, pa.Array]:
        v = v.sort_values(["_block", "row_nr"], kind="stable", ignore_index=True)
        u, place = np.unique(v["_node"].to_numpy(), return_inverse=True)
        z = np.zeros(len(u))
        z[place[::-1]] = v["z"].to_numpy()[::-1]  # the first row of a node stands for it
        view, block = kernels.View(p, u), v["_block"].to_numpy()
        nodes, rows = (np.concatenate([[0], np.cumsum(np.bincount(b, minlength=len(p.starts)))]) for b in (view.block, block))
        return {
            "nodes": _lists(nodes, p.local[u]), "pz": _lists(nodes, view.multiply(z) / np.sqrt(sample_size)),
            "rest_logdet": pa.array(view.others.factor.logdets if len(view.rest) else np.zeros(len(p.starts))),
            "place": _lists(rows, place - nodes[block]), "row_nr": _lists(rows, v["row_nr"].to_numpy()), "annotations": _lists(rows * len(annotations), v[annotations].to_numpy(float).ravel()),
        }

    arrow = to_arrow_schema(StructType.fromDDL(REML_STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, p, v in pools_of(batch):
                own = batch.select(["block_id", "block_nr", "entries"]).take(pa.array(which))
                columns = dict(zip(own.schema.names, own.columns, strict=True)) | kernel(p, v)
                yield pa.RecordBatch.from_arrays([columns[n].cast(arrow.field(n).type) for n in arrow.names], schema=arrow)

    own = rows.select("block_id", "row_nr", "i", "z", *annotations)
    table = packed(matrix, own)
    order = blocks.select("block_id", F.col("block_nr").cast("long").alias("block_nr")) if blocks is not None else table.select("block_id", F.array_min("rows.row_nr").cast("long").alias("block_nr"))
    state = table.join(order, "block_id").mapInArrow(run, REML_STATE)
    if blocks is None:
        return state
    return order.join(state.drop("block_nr"), "block_id", "left").select(*arrow.names)


@dataclass
class RemlBlock:
    """A pool of blocks under given parameters: their numbers in the batch, the likelihood of their Pz, and how variants' variances change it."""

    which: np.ndarray
    gaussian: kernels.Gaussian
    place: np.ndarray
    row_nr: np.ndarray
    annotations: np.ndarray
    eta: np.ndarray


def reml_blocks(batch: pa.RecordBatch, theta: np.ndarray, sample_size: float, denominator: float, intercept: float, method: str = "exact") -> Iterator[RemlBlock]:
    """The blocks of a batch of states but for those without variants; with estimates each block is alone, as it has its own probes."""
    there = np.flatnonzero(batch.column("nodes").value_lengths().fill_null(0).to_numpy())
    if not len(there):
        return
    batch = batch.take(pa.array(there))
    matrices = Matrices(batch)
    flat = {c: np.asarray(batch.column(c).flatten()) for c in ("nodes", "pz", "place", "row_nr", "annotations")}
    node_at, row_at = (np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())]) for c in ("nodes", "place"))
    annotations, rest_logdet = flat["annotations"].reshape(-1, len(theta)), batch.column("rest_logdet").to_numpy()
    for which in matrices.pools(node_at, flat["nodes"], method == "exact"):
        p, count, rows = matrices.of(which), np.diff(node_at)[which], np.diff(row_at)[which]
        u, r = _ranges(node_at[which], count), _ranges(row_at[which], rows)
        nodes, place = flat["nodes"][u] + np.repeat(p.starts, count), flat["place"][r] + np.repeat(np.cumsum(count) - count, rows)
        a = annotations[r]
        eta = a @ theta
        whole = p.scaled(intercept / sample_size).with_diagonal(nodes, np.bincount(place, kernels.softplus(eta) / denominator, len(nodes)))
        rest = rest_logdet[which] + (p.sizes - count) * np.log(intercept / sample_size)
        yield RemlBlock(there[which], kernels.Gaussian(whole, flat["pz"][u], nodes, rest), place, flat["row_nr"][r], a, eta)


def reml_sums(state: DataFrame, theta: np.ndarray, sample_size: float, denominator: float, intercept: float, method: str = "exact", n_samples: int = 100, seed: int = 0) -> DataFrame:
    """block_id, block_nr, ll, gradient and Hessian (as arrays) of each block; zeros for a block without variants. No shuffle.

    With an estimated diagonal a block's probes depend on the seed and the block alone, so that they are the same in every evaluation.
    """
    theta, k = np.asarray(theta, float), len(theta)
    schema = "block_id string, block_nr long, ll double, gradient array<double>, hessian array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ll, gradient, hessian = np.zeros(n), np.zeros((n, k)), np.zeros((n, k * k))
            for b in reml_blocks(batch, theta, sample_size, denominator, intercept, method):
                by_row = kernels.sigmoid(b.eta) / denominator
                slope = np.stack([np.bincount(b.place, a * by_row, len(b.gaussian.b)) for a in b.annotations.T], 1)
                ll[b.which], hessian[b.which] = b.gaussian.likelihoods(), b.gaussian.hessians(slope).reshape(-1, k * k)
                gradient[b.which] = b.gaussian.gradients(slope, method, n_samples=n_samples, seed=block_seed(seed, batch.column("block_id")[int(b.which[0])].as_py()))
            lists = (_lists(np.arange(n + 1) * x.shape[1], x.ravel()) for x in (gradient, hessian))
            yield pa.RecordBatch.from_arrays([batch.column("block_id"), batch.column("block_nr"), pa.array(ll), *lists], schema=arrow)

    return state.mapInArrow(run, schema)


def block_seed(seed: int, block_id: str) -> int:
    return seed + zlib.crc32(str(block_id).encode())


def reml_terms(matrix: DataFrame, rows: DataFrame, annotations: list[str], theta: list[float], denominator: float = 6e6, intercept: float = 1.0, method: str = "exact", n_samples: int = 100, seed: int = 0) -> DataFrame:
    """Log likelihood, gradient and Hessian of each block as arrays, from rows (block_id, row_nr, i, z, n, annotations); the sample size is the mean n."""
    rows = cut(rows)  # the mean and the state both need them
    n = rows.agg(F.avg("n")).first()[0]
    return reml_sums(reml_state(matrix, rows, annotations, n), theta, n, denominator, intercept, method, n_samples, seed).drop("block_nr")


def estimate_precision(correlations: DataFrame, penalty: float = 0.0, sweeps: int = 25, penalised_sweeps: int = 0) -> DataFrame:
    """Precision entries (block_id, i, j, value) from correlations (block_id, i, j, value), whose entries are the support too.

    With ``penalised_sweeps`` in two phases: edges are chosen with the penalty, then estimated without it in ``sweeps``. A block's correlations
    and their inverse are dense in its task.
    """

    def kernel(sparse: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        found, names = [], names_of(v)
        for which, _, c in sparse.stacks():
            p = kernels.two_phase_precision(c, c != 0, penalty, penalised_sweeps, sweeps) if penalised_sweeps else kernels.lasso_precision(c, c != 0, penalty, sweeps)
            b, i, j = np.nonzero(p)
            found.append(pd.DataFrame({"block_id": names[which[b]], "i": i, "j": j, "value": p[b, i, j]}))
        return pd.concat(found)

    return per_block(correlations, None, kernel, "block_id string, i int, j int, value double")


def fit_summary(precision: DataFrame, correlations: DataFrame) -> DataFrame:
    """Mean squared difference of R and the correlations on their support, and the mean degree, by block."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        i, j = v["i"].to_numpy(), v["j"].to_numpy()
        r = np.empty(len(v))
        for node in np.unique(i):
            r[i == node] = p.factor.column(node)[j[i == node]]
        return pd.DataFrame({"block_id": [v["block_id"].iloc[0]], "mse": [float(((r - v["value"].to_numpy()) ** 2).mean())], "degree": [float((p.value != 0).sum() / len(p) - 1)]})

    return per_block(precision, correlations, kernel, "block_id string, mse double, degree double", together=False)


def partial_terms(matrix: DataFrame, rows: DataFrame, sample_size: float, intercept: float = 1.0) -> DataFrame:
    """Likelihood of each block where nodes may lack a Z, with its gradients: rows (block_id, i, z nullable, sigma2), one a node."""

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("i", ignore_index=True)
        seen = v.loc[v["z"].notna(), "i"].to_numpy()
        pz = kernels.multiply(p, v["z"].dropna().to_numpy(), seen) / np.sqrt(sample_size)
        ll, by_node, by_intercept = kernels.partial_likelihood(p, pz, v["sigma2"].to_numpy(), seen, sample_size, intercept)
        return pd.DataFrame({"block_id": [v["block_id"].iloc[0]], "ll": [ll], "gradient": [by_node.tolist()], "intercept_gradient": [by_intercept]})

    return per_block(matrix, rows, kernel, "block_id string, ll double, gradient array<double>, intercept_gradient double", together=False)
