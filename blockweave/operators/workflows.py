"""Whole workflows over blocks: weights, clumps, surrogates, REML inputs and fits, simulation, imputation, quality control.

Variants meet blocks and variant lists by joins; a factorisation runs in one block's task (``per_block``), small blocks in pools;
what blocks yield is added up or put back on the rows by joins.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockweave.functions import kernels
from blockweave.functions.scalars import chromosome, heterozygosity
from blockweave.functions.sparse import Sparse
from blockweave.operators.joins import merge_snplists, partition_variants, reml_join
from blockweave.operators.lineage import cut
from blockweave.operators.ordering import numbered
from blockweave.operators.precision import block_seed, blup, clump, names_of, per_block, reml_blocks, reml_state, reml_sums
from blockweave.operators.statistics import exclude_large_chi2


def _placed(sumstats: DataFrame, catalog: DataFrame | None, info: DataFrame) -> DataFrame:
    """Statistics with their blocks; without a catalog all belong to the one block of the variant list."""
    if catalog is not None:
        return partition_variants(sumstats, catalog)
    one = info.select("block_id").distinct().limit(2)
    return sumstats.join(F.broadcast(one), how="cross") if one.count() == 1 else sumstats  # one row


def _scatter(rows: DataFrame, found: DataFrame, value: str, otherwise: object) -> DataFrame:
    """Every row of the statistics with what was found for it; the others get ``otherwise``."""
    got = found.select("block_id", F.col("sumstat_row").alias("row_nr"), value)
    return rows.join(got, ["block_id", "row_nr"], "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def _merged(info: DataFrame, placed: DataFrame, by: str) -> DataFrame:
    """Representatives of merged nodes, as rows of the block kernels (i is the node of the whole block)."""
    return merge_snplists(info, placed, by).where("is_representative").select("block_id", "sumstat_row", F.col("index").alias("i"), F.col("Z").alias("z"))


def run_blup(matrix: DataFrame, info: DataFrame, sumstats: DataFrame, sigma2: float, sample_size: float, catalog: DataFrame | None = None, by: str = "SNP") -> DataFrame:
    """Weights of every statistic that lies in a block; those that match no variant have weight 0.

    matrix: block_id, i, j, value; info: block_id, row_nr, index, site_ids, position, alleles; sumstats: row_nr, CHR, POS, SNP, REF,
    ALT, Z. Statistics outside all blocks of the catalog are left out.
    """
    placed = _placed(sumstats, catalog, info)
    rows = _merged(info, placed, by).select("block_id", F.col("sumstat_row").alias("row_nr"), "i", "z", F.lit(float(sample_size)).alias("n"), F.lit(True).alias("is_representative"))
    found = blup(matrix, rows, sigma2).withColumnRenamed("row_nr", "sumstat_row")
    return _scatter(placed, found, "weight", 0.0)


def run_clump(matrix: DataFrame, info: DataFrame, sumstats: DataFrame, rsq: float = 0.1, chi2: float = 30.0, catalog: DataFrame | None = None, by: str = "POS") -> DataFrame:
    """Lead flags of every statistic that lies in a block; those that match no variant are no leads."""
    placed = _placed(sumstats, catalog, info)
    rows = _merged(info, placed, by).select("block_id", F.col("sumstat_row").alias("row_nr"), "i", "z", F.lit(True).alias("is_representative"))
    found = clump(matrix, rows, rsq, chi2).withColumnRenamed("row_nr", "sumstat_row")
    return _scatter(placed, found, "is_index", False)


# ---- REML


def surrogate_markers(matrix: DataFrame, variants: DataFrame, surrogates: DataFrame | None = None) -> DataFrame:
    """Variants (block_id, row_nr, i, z) with a node that has a Z: their own, that of the surrogate map
    (block_id, i, surrogate), or the seen one of the highest squared correlation. Adds surrogate, z and method (null where Z was there).

    The first variant with a Z stands for its node. A block without any Z is an error.
    """
    first = Window.partitionBy("block_id", "i").orderBy(F.col("z").isNull(), "row_nr")
    seen = variants.where("z is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("block_id", F.col("i").alias("surrogate"), F.col("z").alias("zs"))
    mapped = surrogates.select("block_id", "i", F.col("surrogate").alias("mapped")) if surrogates is not None else variants.select("block_id", "i").limit(0).withColumn("mapped", F.lit(None).cast("int"))
    on = lambda name: seen.select("block_id", F.col("surrogate").alias(name), F.col("zs").alias(f"z_{name}"))
    tried = variants.join(on("i"), ["block_id", "i"], "left").join(mapped, ["block_id", "i"], "left").join(on("mapped"), ["block_id", "mapped"], "left")
    open_nodes = tried.where("z is null and z_i is null and z_mapped is null").select("block_id", "i").distinct()

    def nearest(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        lack = v[~v["seen"]]
        best = kernels.most_correlated(p, lack["_node"].to_numpy(), np.sort(v.loc[v["seen"], "_node"].to_numpy()))
        return pd.DataFrame({"block_id": lack["block_id"], "i": lack["i"], "best": p.local[best]})

    nodes = seen.select("block_id", F.col("surrogate").alias("i"), F.lit(True).alias("seen")).union(open_nodes.select("block_id", "i", F.lit(False)))
    best = per_block(matrix, nodes, nearest, "block_id string, i int, best int").join(on("best"), ["block_id", "best"])
    out = tried.join(best, ["block_id", "i"], "left")
    method = F.when(F.col("z").isNotNull(), None).when(F.col("z_i").isNotNull(), "same_index").when(F.col("z_mapped").isNotNull(), "surrogate_map").otherwise("correlation")
    node = F.when(F.col("z").isNotNull() | F.col("z_i").isNotNull(), F.col("i")).when(F.col("z_mapped").isNotNull(), F.col("mapped")).otherwise(F.col("best"))
    return out.select(*[c for c in variants.columns if c != "z"], node.cast("int").alias("surrogate"), F.coalesce("z", "z_i", "z_mapped", "z_best").alias("z"), method.alias("method"))


def block_order(catalog: DataFrame) -> DataFrame:
    """block_id and block_nr of a catalog, in the order of the genome, numbered in range partitions."""
    places = catalog.select("block_id", chromosome(F.col("chrom")).alias("chrom"), "chromStart", "chromEnd")
    return numbered(places, ["chrom", "chromStart", "chromEnd", "block_id"], "block_nr").select("block_id", "block_nr")


def prepare_reml_inputs(matrix: DataFrame, info: DataFrame, sumstats: DataFrame, annotations: DataFrame, names: list[str], catalog: DataFrame, by: str = "SNP", surrogates: bool = False, surrogate_map: DataFrame | None = None) -> DataFrame:
    """Rows (block_id, row_nr, i, z, n, annotations) for ``reml_fit``; row_nr is that of the annotations.

    Statistics need N. With ``surrogates`` annotated variants without a statistic stay and get the Z of a surrogate. Blocks of the catalog that
    get no row are kept by giving ``block_order(catalog)`` to the fit.
    """
    if "N" not in sumstats.columns:
        raise ValueError("the statistics have no column N")
    joined = reml_join(sumstats, annotations, surrogates, (by,))
    placed = partition_variants(joined, catalog)
    merged = merge_snplists(info, placed, by, extra=("N", *names))
    rows = merged.select("block_id", F.col("sumstat_row").alias("row_nr"), F.col("index").alias("i"), F.col("Z").alias("z"), F.col("N").alias("n"), *names)
    if surrogates:
        lent = surrogate_markers(matrix, rows, surrogate_map)
        rows = lent.withColumn("i", F.col("surrogate")).drop("surrogate", "method")
    return rows


@dataclass
class RemlFit:
    """Result of ``reml_fit``: small arrays only, by annotation; ``groups`` is the number of jackknife groups of blocks."""

    annotations: list[str]
    parameters: np.ndarray
    likelihood: float
    converged: bool
    log: list[dict] = field(default_factory=list)
    heritability: np.ndarray | None = None
    enrichment: np.ndarray | None = None
    jackknife: dict[str, np.ndarray] = field(default_factory=dict)
    groups: int = 0

    def table(self) -> list[tuple]:
        """Rows of ``reml_results``."""
        out = []
        for k, name in enumerate(self.annotations):
            row = [name]
            for metric, values in (("enrichment", self.enrichment), ("heritability", self.heritability), ("parameters", self.parameters)):
                jack = self.jackknife.get(metric)
                row += [float(values[k]), float(jackknife_error(jack)[k]), wald_log10_p(jack[:, k])]
            out.append(tuple(row))
        return out


def jackknife_error(estimates: np.ndarray) -> np.ndarray:
    """Standard errors from leave-one-out estimates, with the sample variance; nan below two."""
    n = len(estimates)
    return np.sqrt((n - 1) * estimates.var(0, ddof=1)) if n > 1 else np.full(estimates.shape[1], np.nan)


def wald_log10_p(estimates: np.ndarray) -> float:
    """log10 of the two-sided p value of the mean of leave-one-out estimates; 0 if they are all equal, nan below two."""
    if len(estimates) < 2 or np.isnan(estimates).any():
        return float("nan")
    if np.all(estimates == estimates[0]):
        return 0.0
    se = float(np.sqrt((len(estimates) - 1) * estimates.var(ddof=1)))
    return float((np.log(2) + kernels.log_normal_tail(np.array([abs(estimates.mean() / se)]))[0]) / np.log(10)) if se > 0 else float("nan")


def trust_region_step(g: np.ndarray, h: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """Step of a Newton iteration whose Hessian's diagonal is raised, and the increase that it promises, which must not be below -1e-6."""
    step = np.linalg.solve(h + weight * np.diag(np.diag(h) - np.finfo(float).eps), -g)
    promised = float(step @ g + 0.5 * step @ h @ step)
    if np.isfinite(step).all() and not promised >= -1e-6:
        raise ValueError("the increase that a step promises is below -1e-6")
    return step, promised


def leave_one_out_parameters(gradients: np.ndarray, hessians: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """theta + H_loo^-1 g_loo for each group of blocks, nan where that is singular; the sign is that of the published method, opposite to a step's."""
    g, h = gradients.sum(0), hessians.sum(0)
    out = np.full((len(gradients), len(theta)), np.nan)
    for k, (gb, hb) in enumerate(zip(gradients, hessians, strict=True)):
        with contextlib.suppress(np.linalg.LinAlgError):
            out[k] = theta + np.linalg.solve(h - hb + 1e-12 * np.eye(len(theta)), g - gb)
    return out


def summed_arrays(df: DataFrame, column: str) -> np.ndarray:
    """Sums by place of arrays of one length, in Spark; as many numbers as an array has reach the driver."""
    rows = df.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(max((r["at"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["at"]] = r["x"]
    return out


def reml_fit(
    matrix: DataFrame, rows: DataFrame, annotations: list[str], start: list[float] | None = None, iterations: int = 50, denominator: float = 6e6, intercept: float = 1.0, tolerance: float = 0.01, window: int = 3,
    radius: float = 1e-3, grow: float = 5.0, low: float = 1e-4, high: float = 0.99, tries: int = 100, least_gain: float = 1e-6, groups: int = 100, max_chi2: float | None = None,
    blocks: DataFrame | None = None, method: str = "exact", n_samples: int = 100, seed: int = 0,
) -> RemlFit:
    """Trust-region Newton over all blocks: one job an evaluation, sums of p + p * p numbers on the driver.

    The state of the blocks (``precision.reml_state``) is shuffled once and kept; an evaluation maps over it. Converged when the likelihood has
    changed by less than window * tolerance over the last ``window`` accepted steps; a step to a likelihood that is no number is refused.
    Jackknife groups are stretches of the catalog (``blocks``, see ``block_order``), the first ones longer by one block where they don't divide it;
    their parameters come from the state before the last step. ``method`` says how inverse diagonals are got (exact, xdiag, xnys, hutchinson).
    """
    k = len(annotations)
    if max_chi2 is not None:
        rows = exclude_large_chi2(rows.withColumn("Z", F.col("z")), max_chi2)[0].drop("Z")
    rows = cut(rows)  # the mean and the state both need them
    n = rows.agg(F.avg("n")).first()[0]
    if n is None:
        raise ValueError("no variants are left")
    state = reml_state(matrix, rows, annotations, float(n), blocks).persist()

    def terms(theta: np.ndarray) -> DataFrame:
        return reml_sums(state, theta, float(n), denominator, intercept, method, n_samples, seed)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = summed_arrays(terms(theta).select(F.concat(F.array("ll"), "gradient", "hessian").alias("x")), "x")
        return float(sums[0]), sums[1 : k + 1], sums[k + 1 :].reshape(k, k)

    try:
        theta, weight, bad, log, converged = np.array(start or [0.0] * k), radius, True, [], False
        now = before = evaluate(theta)
        at = theta
        for _ in range(iterations):
            before, at, previous, accepted = now, theta, radius if bad else weight, False
            weight = previous
            for _ in range(tries):
                try:
                    step, promised = trust_region_step(now[1], now[2], weight)
                except np.linalg.LinAlgError:
                    break
                if not np.isfinite(step).any():
                    break
                new = evaluate(theta + step)
                rho = (new[0] - now[0]) / promised if promised else np.nan
                if not np.isfinite(rho):
                    rho = np.inf if promised == 0 else -np.inf
                if rho < low and not (promised < least_gain and rho >= 0):
                    weight = max(radius, weight * grow)
                    continue
                accepted, theta, now = True, theta + step, new
                if rho > high:
                    weight /= grow
                break
            if not accepted:
                break
            bad = weight > previous * grow
            log.append({"iteration": len(log) + 1, "likelihood": now[0], "likelihood_change": now[0] - before[0], "trust_region_lambda": weight})
            if len(log) > window and abs(log[-1]["likelihood"] - log[-window]["likelihood"]) < window * tolerance:
                converged = True
                break
        fit = RemlFit(annotations, theta, now[0], converged, log)
        sums = annotation_sums(state, theta[None], denominator)
        fit.heritability, size = sums[0, 0], sums[1, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            fit.enrichment = size[0] * fit.heritability / (fit.heritability[0] * size) if fit.heritability[0] and size[0] else np.full(k, np.nan)
        _jackknife(fit, state, terms(at), groups, denominator)
        return fit
    finally:
        state.unpersist()


def annotation_sums(state: DataFrame, thetas: np.ndarray, denominator: float) -> np.ndarray:
    """Sums of annotation * heritability, and of the annotations, over all variants under each row of parameters: (2, rows, annotations)."""
    g, k = thetas.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, g, k))
        for batch in batches:
            column = batch.column("annotations")
            a = np.asarray(column.flatten()).reshape(-1, k)
            for at in range(0, len(a), 10_000):
                part = a[at : at + 10_000]
                total[0] += kernels.softplus(thetas @ part.T) / denominator @ part
                total[1] += part.sum(0)
        yield pa.RecordBatch.from_pydict({"x": [total.ravel()]}, schema=pa.schema([("x", pa.list_(pa.float64()))]))

    return summed_arrays(state.select("annotations").mapInArrow(run, "x array<double>"), "x").reshape(2, g, k)


def jackknife_groups_of(blocks: DataFrame, groups: int) -> DataFrame:
    """block_id and jackknife_group (from 0) of blocks by their block_nr; no more groups than blocks, the first ones longer by one block where they don't divide them."""
    places = numbered(blocks.select("block_id", "block_nr"), ["block_nr", "block_id"], "_place")
    count = blocks.count()
    n = max(1, min(groups, count))
    size, longer = max(1, count // n), count % n
    place, end = F.col("_place"), longer * (size + 1)  # of the longer groups
    group = F.when(place < end, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - end) / size))
    return places.select("block_id", group.cast("int").alias("jackknife_group"))


def _jackknife(fit: RemlFit, state: DataFrame, terms: DataFrame, groups: int, denominator: float) -> None:
    """Leave-one-out parameters by groups of blocks, and heritabilities and enrichments under each of them."""
    k = len(fit.annotations)
    grouped = terms.join(jackknife_groups_of(state.select("block_id", "block_nr"), groups), "block_id")
    cells = grouped.select("jackknife_group", F.posexplode(F.concat("gradient", "hessian")).alias("at", "x")).groupBy("jackknife_group", "at").agg(F.sum("x").alias("x")).collect()  # groups * (k + k * k) numbers
    sums = np.zeros((max(c["jackknife_group"] for c in cells) + 1, k + k * k))
    for c in cells:
        sums[c["jackknife_group"], c["at"]] = c["x"]
    theta = leave_one_out_parameters(sums[:, :k], sums[:, k:].reshape(-1, k, k), fit.parameters)
    h, size = annotation_sums(state, theta, denominator)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = h / size
        fit.jackknife = {"parameters": theta, "heritability": h, "enrichment": share / share[:, :1], "difference": share - share[:, :1]}
    fit.groups = len(theta)


RESULTS = "name string, enrichment double, enrichment_SE double, enrichment_log10pval double, heritability double, heritability_SE double, heritability_log10pval double, parameter double, parameter_SE double, parameter_log10pval double"


def reml_results(spark: SparkSession, fit: RemlFit, layout: str = "tall", name: str = "trait", metric: str = "parameters") -> DataFrame:
    """tall: a row an annotation with all metrics; wide: one row with value, SE and log10 p of one metric by annotation."""
    tall = spark.createDataFrame(fit.table(), RESULTS)
    if layout == "tall":
        return tall
    stem = {"parameters": "parameter"}.get(metric, metric)
    cells = {r["name"]: [r[stem], r[f"{stem}_SE"], r[f"{stem}_log10pval"]] for r in tall.collect()}
    columns = [f"`{a}{end}` double" for a in fit.annotations for end in ("", "_SE", "_log10pval")]
    return spark.createDataFrame([(name, *[v for a in fit.annotations for v in cells[a]])], ", ".join(["name string", *columns]))


def convergence_results(spark: SparkSession, fit: RemlFit) -> tuple[DataFrame, DataFrame]:
    """Summary row, and the likelihood change and trust-region weight of each iteration."""
    summary = spark.createDataFrame([(fit.converged, len(fit.log), float(fit.likelihood))], "converged boolean, num_iterations int, final_likelihood double")
    rows = [(x["iteration"], float(x["likelihood_change"]), float(x["trust_region_lambda"])) for x in fit.log]
    return summary, spark.createDataFrame(rows, "iteration int, likelihood_change double, trust_region_lambda double")


def variant_scores(matrix: DataFrame, rows: DataFrame, fit: RemlFit, variants: DataFrame, denominator: float = 6e6, intercept: float = 1.0, blocks: DataFrame | None = None, method: str = "exact", n_samples: int = 100, seed: int = 0) -> DataFrame:
    """row_nr, gradient and Hessian of the likelihood for each variant's linear predictor, its heritability h2 and its jackknife_group.

    Variants without a node have gradient, Hessian and h2 of 0 and no group. The Hessian is the node's average information by the square of the
    slope of h2, and the node's gradient by its curvature.
    """
    rows = cut(rows)  # the mean and the state both need them
    n = float(rows.agg(F.avg("n")).first()[0])
    state = reml_state(matrix, rows, fit.annotations, n, blocks)
    schema = "row_nr long, block_id string, gradient double, hessian double, h2 double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("block_id").to_pylist(), object)
            for b in reml_blocks(batch, fit.parameters, n, denominator, intercept, method):
                own = {"n_samples": n_samples, "seed": block_seed(seed, names[b.which[0]])}
                gradient, hessian = b.gaussian.node_gradient(method, **own)[b.place], b.gaussian.node_hessian(method, **own)[b.place]
                slope = kernels.sigmoid(b.eta)
                out = {"row_nr": b.row_nr, "block_id": names[b.which[b.gaussian.view.block[b.place]]], "gradient": gradient * slope / denominator, "hessian": hessian * (slope / denominator) ** 2 + gradient * slope * (1 - slope) / denominator, "h2": kernels.softplus(b.eta) / denominator}
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    scores = state.mapInArrow(run, schema).join(jackknife_groups_of(state.select("block_id", "block_nr"), fit.groups or 1), "block_id")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gradient", "hessian", "h2")]
    return variants.select("row_nr").join(scores, "row_nr", "left").select("row_nr", *zero, "jackknife_group")


def project_out(rows: DataFrame, value: str, annotations: list[str]) -> DataFrame:
    """``value`` without its least-squares fit on the annotations, over all rows; p * p + p sums reach the driver, added up in each task."""
    k = len(annotations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            total += x[:, :k].T @ x
        yield pa.RecordBatch.from_pydict({"x": [total.ravel()]}, schema=pa.schema([("x", pa.list_(pa.float64()))]))

    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*annotations, value])]
    sums = summed_arrays(rows.select(*columns).na.drop().mapInArrow(run, "x array<double>"), "x").reshape(k, k + 1)
    beta = np.linalg.lstsq(sums[:, :k], sums[:, k], rcond=None)[0]
    fitted = F.lit(0.0)
    for a, b in zip(annotations, beta, strict=True):
        fitted = fitted + F.col(a) * F.lit(float(b))
    return rows.withColumn(value, F.col(value) - fitted)


# ---- simulation


def simulate(matrix: DataFrame, variants: DataFrame, sample_size: float, heritability: float, weights: list[float] = (1.0,), variances: list[float] = (1.0,), link: Callable[[DataFrame], Column] | None = None, alpha: float = 0.0, seed: int = 0) -> DataFrame:
    """Effects and Z of variants (block_id, row_nr, i, af): beta, alpha (marginal effect) and z.

    A variant draws its variance from the mixture; ``link`` may scale it by annotations, and (2p(1-p))^alpha by frequency.
    Marginal effects are R beta, scaled so that the sum of beta * alpha is the heritability; z adds noise with covariance R.
    Draws are a function of seed and row, so they don't depend on how rows are dealt.
    """
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "block_id", "row_nr"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    normal = lambda salt: F.sqrt(-2 * F.log(uniform(salt))) * F.cos(2 * np.pi * uniform(salt + 1))
    edges = np.cumsum(weights)
    if edges[-1] > 1 + 1e-9 or min(weights) < 0:
        raise ValueError("mixture weights must not be negative nor add up to more than 1")
    chosen = F.lit(0.0)
    for edge, v in zip(reversed(edges), reversed(list(variances)), strict=True):
        chosen = F.when(F.col("_u") < float(edge), F.lit(float(v))).otherwise(chosen)
    scale = (link(variants) if link else F.lit(1.0)) * (F.pow(heterozygosity(F.col("af")), F.lit(alpha)) if alpha else F.lit(1.0))
    drawn = variants.withColumn("_u", uniform(1)).withColumn("beta", F.sqrt(chosen * scale) * normal(3)).drop("_u")

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        nodes = v["_node"].to_numpy()
        sums = np.bincount(nodes, v["beta"].to_numpy(), len(p))
        draws = [np.random.default_rng([seed, *name.encode()]).standard_normal(n) for name, n in zip(names_of(v), p.sizes.tolist(), strict=True)]
        noise = p.factor.noise(np.concatenate(draws))
        return pd.DataFrame({"block_id": v["block_id"], "row_nr": v["row_nr"], "alpha": p.factor.solve(sums)[nodes], "noise": noise[nodes]})

    # written once: the sum and the rows both need it
    effects = cut(drawn.join(per_block(matrix, drawn.select("block_id", "row_nr", "i", "beta"), kernel, "block_id string, row_nr long, alpha double, noise double"), ["block_id", "row_nr"]))
    total = effects.agg(F.sum(F.col("beta") * F.col("alpha")).alias("_s"))  # one row
    factor = F.when(F.col("_s") > 0, F.sqrt(F.lit(float(heritability)) / F.col("_s"))).otherwise(0.0)
    scaled = effects.join(F.broadcast(total)).withColumn("beta", F.col("beta") * factor).withColumn("alpha", F.col("alpha") * factor)
    return scaled.withColumn("z", F.col("noise") + np.sqrt(sample_size) * F.col("alpha")).drop("_s", "noise")


def simulate_populations(
    matrices: DataFrame, variants: DataFrame, sample_sizes: list[float], heritability: np.ndarray, weights: list[float] = (1.0,), covariances: list[np.ndarray] | None = None,
    link: Callable[[DataFrame], Column] | None = None, dependent_polygenicity: bool = False, alpha: float = -1.0, missingness: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Effects and statistics of several populations: block_id, population, row_nr, i, beta_per_allele, beta_per_sd, alpha, z, n, af.

    matrices: block_id, population, i, j, value; variants: block_id, row_nr, i, af (array, one frequency a population), and what ``link`` reads.
    A causal variant belongs to a component (by ``weights``, whose sum is the share of causal ones) and has normal effects by allele with that
    component's covariance over populations (by default ``heritability``, whose diagonal is each population's and whose correlations are genetic ones).
    ``link`` (not negative) and (p (1 - p))^alpha, p the mean frequency, scale variances; with ``dependent_polygenicity`` they scale the chance of
    being causal instead, at most 1. Effects are then scaled so that the squares by standard deviation add up to each heritability. A node that a
    population's matrix lacks gives no statistics there; of the others a share ``missingness`` is left out at random.
    Draws are functions of the seed and the row.
    """
    m = len(sample_sizes)
    heritability = np.asarray(heritability, float).reshape(m, m)
    if min(weights) < 0 or sum(weights) > 1 + 1e-9:
        raise ValueError("mixture weights must not be negative nor add up to more than 1")
    halves = [np.linalg.cholesky(np.asarray(c, float).reshape(m, m) + 1e-12 * np.eye(m)) for c in (covariances or [heritability] * len(weights))]
    uniform = lambda salt, *more: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "block_id", "row_nr", *more), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    normal = lambda salt: F.sqrt(-2 * F.log(uniform(salt))) * F.cos(2 * np.pi * uniform(salt + 1))

    mean = F.aggregate("af", F.lit(0.0), lambda t, x: t + x) / m
    known = variants.withColumn("_p", F.least(F.greatest(mean, F.lit(1e-9)), F.lit(1 - 1e-9))).withColumn("_spread", F.col("_p") * (1 - F.col("_p"))).withColumn("_link", link(variants).cast("double") if link else F.lit(1.0))
    share = float(sum(weights))
    if dependent_polygenicity:
        known = known.withColumn("_rel", F.col("_link") * F.pow("_spread", F.lit(1.0 + alpha)))
        whole = known.agg(F.sum("_rel").alias("_sum"), F.count(F.lit(1)).alias("_count"))  # one row
        known = known.join(F.broadcast(whole)).withColumn("_causal", F.least(F.lit(1.0), F.lit(share) * F.col("_rel") * F.col("_count") / F.col("_sum")))
        size = F.pow("_spread", F.lit(-0.5))
    else:
        known = known.withColumn("_causal", F.lit(share))
        size = F.sqrt(F.pow("_spread", F.lit(float(alpha))) * F.col("_link"))
    edges = (np.cumsum(weights) / share).tolist() if share else [1.0] * len(weights)
    component = F.lit(len(weights) - 1)
    for k in range(len(weights) - 2, -1, -1):
        component = F.when(uniform(2) < edges[k], k).otherwise(component)
    draws = F.array(*[normal(10 + 2 * k) for k in range(m)])
    rows_of = F.array(*[F.array(*[F.lit(float(x)) for x in half.ravel()]) for half in halves])
    mixed = known.withColumn("_half", F.get(rows_of, component)).withColumn("_draws", draws).withColumn("_on", uniform(1) < F.col("_causal"))
    effect = [sum((F.get("_half", F.lit(k * m + q)) * F.get("_draws", F.lit(q)) for q in range(k + 1)), F.lit(0.0)) for k in range(m)]
    beta = F.array(*[F.when(F.col("_on"), e * size).otherwise(0.0) for e in effect])
    drawn = mixed.withColumn("_beta", beta).select("block_id", "row_nr", "i", F.posexplode(F.arrays_zip("_beta", "af")).alias("population", "x"))
    drawn = drawn.select("block_id", "row_nr", "i", "population", F.col("x._beta").alias("beta_per_allele"), F.col("x.af").alias("af")).withColumn("beta_per_sd", F.col("beta_per_allele") * F.sqrt(heterozygosity(F.col("af"))))
    drawn = cut(drawn)
    sums = {r["population"]: r["s"] for r in drawn.groupBy("population").agg(F.sum(F.col("beta_per_sd") * F.col("beta_per_sd")).alias("s")).collect()}  # a row a population
    scale = F.get(F.array(*[F.lit(float(np.sqrt(heritability[k, k] / sums[k])) if sums.get(k) else 0.0) for k in range(m)]), F.col("population"))
    drawn = drawn.withColumn("beta_per_allele", F.col("beta_per_allele") * scale).withColumn("beta_per_sd", F.col("beta_per_sd") * scale)

    def kernel(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        there = np.flatnonzero(p.diagonal)
        nodes = v["i"].to_numpy()
        v = v[np.isin(nodes, there)]
        if v.empty:
            return v
        place = np.searchsorted(there, v["i"].to_numpy())
        factor = p.take(there).factor
        rng = np.random.default_rng([seed, *v["block_id"].iloc[0].encode()])
        return pd.DataFrame({"block_id": v["block_id"], "row_nr": v["row_nr"], "alpha": factor.solve(np.bincount(place, v["beta_per_sd"].to_numpy(), len(there)))[place], "noise": factor.noise(rng.standard_normal(len(there)))[place]})

    key = F.concat_ws("|", "population", "block_id").alias("block_id")
    found = per_block(matrices.select(key, "i", "j", "value"), drawn.select(key, "row_nr", "i", "beta_per_sd"), kernel, "block_id string, row_nr long, alpha double, noise double", together=False).withColumnRenamed("block_id", "_key")
    n = F.get(F.array(*[F.lit(float(x)) for x in sample_sizes]), F.col("population"))
    out = drawn.withColumn("_key", F.concat_ws("|", "population", "block_id")).join(found, ["_key", "row_nr"]).where(uniform(3, "population") >= missingness)
    return out.withColumn("n", n).select("block_id", "population", "row_nr", "i", "beta_per_allele", "beta_per_sd", "alpha", (F.sqrt("n") * F.col("alpha") + F.col("noise")).alias("z"), "n", "af")


# ---- imputation, quality control, prediction


def _for_rows(matrix: DataFrame, rows: DataFrame, kernel: Callable[[Sparse, np.ndarray, pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """A value for each row (block_id, row_nr, i, z, ...), one a node, from its block."""

    def run(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block_id": v["block_id"], "row_nr": v["row_nr"], name: kernel(p, v["_node"].to_numpy(), v)})

    return per_block(matrix, rows, run, f"block_id string, row_nr long, {name} double")


def impute_z(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """Z of rows without one, from those of their block; rows (one a node) that have a Z keep it."""
    return _for_rows(matrix, rows, lambda p, i, v: kernels.impute(p, i, v["z"].fillna(0.0).to_numpy(), v["z"].notna().to_numpy()), "z")


def outlier_chi2(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """Chi-square of each Z against its prediction from the other half of its block; ``half`` (boolean) says which half."""
    return _for_rows(matrix, rows, lambda p, i, v: kernels.halves_chi2(p, i, v["z"].to_numpy(), v["half"].to_numpy(bool)), "chi2")


def regularise_z(matrix: DataFrame, rows: DataFrame, strength: float) -> DataFrame:
    """Z shrunk towards what its block's correlations support."""
    return _for_rows(matrix, rows, lambda p, i, v: kernels.regularise(p, i, v["z"].to_numpy(), strength), "z")


def project_weights(matrix: DataFrame, weights: DataFrame, targets: DataFrame) -> DataFrame:
    """Weights (block_id, row_nr, i, weight) carried to other nodes (block_id, i): those that predict the same score best."""

    def run(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        own, target = v[~v["target"]], v[v["target"]]
        full, to = np.bincount(own["_node"], own["weight"], len(p)), target["_node"].to_numpy()
        return pd.DataFrame({"block_id": target["block_id"], "i": target["i"], "weight": kernels.multiply(p, p.factor.solve(full)[to], to)})

    rows = weights.select("block_id", "i", "weight", F.lit(False).alias("target")).union(targets.select("block_id", "i", F.lit(0.0), F.lit(True)))
    return per_block(matrix, rows, run, "block_id string, i int, weight double")


def score_accuracy(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """Squared correlation of two scores (weight, truth by block_id, i): (w'Rt)^2 / (w'Rw * t'Rt), sums over blocks."""

    def run(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        w, t = (np.bincount(v["_node"], v[c], len(p)) for c in ("weight", "truth"))
        rw, rt = kernels.solve(p, w), kernels.solve(p, t)
        return pd.DataFrame({"wt": [w @ rt], "ww": [w @ rw], "tt": [t @ rt]})

    sums = per_block(matrix, rows, run, "wt double, ww double, tt double").agg(F.sum("wt").alias("wt"), F.sum("ww").alias("ww"), F.sum("tt").alias("tt"))
    return sums.select(F.try_divide(F.col("wt") * F.col("wt"), F.col("ww") * F.col("tt")).alias("r2"))


def score_accuracy_from_z(matrix: DataFrame, rows: DataFrame, sample_size: float) -> DataFrame:
    """Squared correlation of a score (weight) with a trait, from the trait's Z: (w'z)^2 / (N w'Rw), with its z value."""
    ww = rows.select("block_id", "i", F.col("weight").alias("x"))

    def run(p: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        w = np.bincount(v["_node"], v["x"], len(p))
        return pd.DataFrame({"ww": [w @ kernels.solve(p, w)]})

    quadratic = per_block(matrix, ww, run, "ww double").agg(F.sum("ww").alias("ww"))
    linear = rows.agg(F.sum(F.col("weight") * F.col("z")).alias("wz"))
    both = linear.join(F.broadcast(quadratic))  # one row each
    return both.select(F.try_divide(F.col("wz") * F.col("wz"), F.col("ww") * F.lit(float(sample_size))).alias("r2"), F.try_divide("wz", F.sqrt("ww")).alias("z"))


def multi_population_blup(matrices: DataFrame, rows: DataFrame, covariance: np.ndarray, sample_sizes: list[float], alpha: float | None = None) -> DataFrame:
    """Weights of several populations at once: rows (block_id, population, i, z), matrices (block_id, population, i, j, value).

    Effects of the populations at a node have the covariance (per standard deviation). D is the block diagonal of the P_k / N_k and S the
    covariance at each node common to all; the posterior mean is S (S + D)^-1 y, one sparse system over all populations, in which
    node i of population k has the number i * m + k. A population's block holds all its nodes.

    With ``alpha`` rows carry af, the prior of population k at a node is scaled by (2 af (1 - af))^(1 + alpha) (the variance of an effect per
    allele is then proportional to heterozygosity to the power alpha), and ``per_allele`` has the weights by allele.
    """
    m = len(sample_sizes)
    size = F.element_at(F.array(*[F.lit(float(n)) for n in sample_sizes]), F.col("population") + 1)
    number = lambda c: (F.col(c) * m + F.col("population")).cast("int").alias(c)
    whole = matrices.select("block_id", number("i"), number("j"), (F.col("value") / size).alias("value"))
    spread = F.sqrt(heterozygosity(F.col("af"))) if alpha is not None else F.lit(1.0)
    scaled = F.pow(spread, F.lit(1.0 + alpha)) if alpha is not None else F.lit(1.0)
    seen = rows.select("block_id", number("i"), (F.col("z") * F.sqrt(size)).alias("z"), spread.cast("double").alias("spread"), scaled.cast("double").alias("scale"))
    schema = "block_id string, population int, i int, weight double" + (", per_allele double" if alpha is not None else "")

    def run(d: Sparse, v: pd.DataFrame) -> pd.DataFrame:
        v = v.drop_duplicates("i").sort_values("i", ignore_index=True)
        node = v["i"].to_numpy() // m
        common, count = np.unique(node, return_counts=True)
        v = v[np.isin(node, common[count == m])]
        if v.empty:
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        active, scale = v["i"].to_numpy(), v["scale"].to_numpy().reshape(-1, m)
        prior = covariance[None] * scale[:, :, None] * scale[:, None, :]
        k, l = np.divmod(np.arange(m * m), m)
        first = active[::m]
        both = Sparse(d.n, np.concatenate([d.i, (first[:, None] + k).ravel()]), np.concatenate([d.j, (first[:, None] + l).ravel()]), np.concatenate([d.value, prior.reshape(-1)]))
        x = kernels.solve(both, kernels.multiply(d, v["z"].to_numpy(), active), active).reshape(-1, m)
        weight = np.einsum("nkl,nl->nk", prior, x).ravel()
        out = pd.DataFrame({"block_id": v["block_id"].iloc[0], "population": active % m, "i": active // m, "weight": weight})
        return out if alpha is None else out.assign(per_allele=weight / v["spread"].to_numpy())

    return per_block(whole, seen, run, schema, together=False)


def correlation_edges(support: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Correlations of the genotype columns that edges (from, to) name: products are summed over individuals (row, variant, value)."""
    one = genotypes.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    a = genotypes.select("row", F.col("variant").alias("from"), F.col("value").alias("x"))
    b = genotypes.select("row", F.col("variant").alias("to"), F.col("value").alias("y"))
    product = support.select("from", "to").distinct().join(a, "from").join(b, ["to", "row"]).groupBy("from", "to").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    side = lambda end, tag: one.select(F.col("variant").alias(end), F.col("n").alias(f"n{tag}"), F.col("s").alias(f"s{tag}"), F.col("q").alias(f"q{tag}"))
    both = product.join(side("from", 1), "from").join(side("to", 2), "to")
    spread = lambda tag: F.col(f"n{tag}") * F.col(f"q{tag}") - F.col(f"s{tag}") * F.col(f"s{tag}")
    return both.select("from", "to", F.try_divide(F.col("n1") * F.col("xy") - F.col("s1") * F.col("s2"), F.sqrt(spread(1) * spread(2))).alias("r"))


def correlation_edgelist(graph: DataFrame, genotypes: DataFrame, path_distance: float = 4.0, minimum_maf: float = 0.01) -> DataFrame:
    """Correlations (from, to, r) of the variants that a graph's edges of a path distance below the threshold tie, from <= to, with their diagonal of ones.

    graph: from, to, weight (a distance); genotypes: row, variant, value (0 or 1). Variants of a minor allele frequency not above the minimum
    have no correlations: neither edges nor a diagonal.
    """
    mean = genotypes.groupBy("variant").agg(F.avg("value").alias("f"))
    common = cut(mean.where(F.least("f", 1 - F.col("f")) > minimum_maf).select("variant"))
    near = graph.where((F.col("weight") < path_distance) & (F.col("from") != F.col("to"))).select(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to")).distinct()
    for end in ("from", "to"):
        near = near.join(common.withColumnRenamed("variant", end), end, "left_semi")
    own = common.select(F.col("variant").alias("from"), F.col("variant").alias("to"), F.lit(1.0).alias("r"))
    return correlation_edges(near, genotypes).select("from", "to", "r").unionByName(own)
