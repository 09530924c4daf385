"""Score tests, jackknife, meta-analysis and filters: DataFrame functions, but for the products of column tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.scalars import log10_two_sided_p


def missingness_filter(sumstats: DataFrame, maximum: float) -> DataFrame:
    """Rows with N of at least (1 - maximum) * max(N). One scalar is broadcast."""
    most = sumstats.agg(F.max("N").alias("_most"))
    return sumstats.join(F.broadcast(most), F.col("N") >= (1 - maximum) * F.col("_most")).drop("_most")


def exclude_large_chi2(variants: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Variants of blocks whose largest squared Z is at most the threshold, and the (block_id, max_chi2) of those dropped.

    A null Z makes its block's maximum unknown, which is an error, and so is it if no block is left.
    """
    known = F.assert_true(F.col("Z").isNotNull(), F.lit("Z is missing"))
    most = variants.groupBy("block_id").agg(F.max(F.when(known.isNull(), F.col("Z") * F.col("Z"))).alias("max_chi2"))
    some = F.assert_true(F.min("max_chi2") <= threshold, F.lit("every block has a chi-square above the threshold"))
    checked = most.join(F.broadcast(most.agg(some.alias("_ok")))).where("_ok is null").drop("_ok")  # one row
    return variants.join(checked.where(F.col("max_chi2") <= threshold).select("block_id"), "block_id", "left_semi"), checked.where(F.col("max_chi2") > threshold)


#: Rows by ``order`` that a task looks at together; borders between them are carried in one row a stretch.
STRETCH = 100_000


def run_ordinals(rows: DataFrame, value: str, order: str, early: bool = True, stretch: int = STRETCH) -> DataFrame:
    """Number of the run of equal values that a row belongs to.

    ``early``: a run's border lies one row early, so its last row counts to the next run; a label that
    comes again later is a new run. Rows are ordered by ``order`` (whole numbers) within ``store``.
    """
    placed = rows.withColumn("_part", F.floor(F.col(order) / stretch))
    inside, parts = Window.partitionBy("store", "_part").orderBy(order), Window.partitionBy("store").orderBy("_part")
    ends = placed.groupBy("store", "_part").agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    beside = ends.select("store", "_part", F.lag("_last").over(parts).alias("_before"), F.lead("_first").over(parts).alias("_after"))
    placed = placed.join(beside, ["store", "_part"])
    other = F.coalesce(F.lead(value).over(inside), F.col("_after")) if early else F.coalesce(F.lag(value).over(inside), F.col("_before"))
    flagged = placed.withColumn("_c", F.coalesce((F.col(value) != other).cast("int"), F.lit(0)))
    sums = flagged.groupBy("store", "_part").agg(F.sum("_c").alias("_n"))
    upto = sums.select("store", "_part", F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_upto"))
    local = F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_local", local).join(upto, ["store", "_part"]).withColumn("run", (F.col("_local") + F.col("_upto")).cast("int")).drop("_part", "_before", "_after", "_c", "_local", "_upto")


def block_scores(rows: DataFrame, annotations: list[str], early: bool = True) -> DataFrame:
    """Sum of annotation * gradient by store, run and annotation. A first run of one row leaves run 0 empty, with the score 0."""
    runs = run_ordinals(rows, "jackknife_block", "row_nr", early)
    long = runs.select("store", "run", F.explode(F.array(*[F.struct(F.lit(a).alias("annotation"), (F.col(a) * F.col("gradient")).alias("value")) for a in annotations])).alias("x")).select("store", "run", "x.*")
    first = rows.select("store").distinct().select("store", F.lit(0).alias("run"), F.explode(F.array(*[F.lit(a) for a in annotations])).alias("annotation"), F.lit(0.0).alias("value"))
    return long.union(first).groupBy("store", "run", "annotation").agg(F.sum("value").alias("score"))


def leave_one_out(blocks: DataFrame, *by: str) -> DataFrame:
    """Block sums with the total of each group and the total without the block."""
    total = blocks.groupBy(*by).agg(F.sum("score").alias("total"))
    return blocks.join(total, list(by)).withColumn("loo", F.col("total") - F.col("score"))


def jackknife_error(value: str, population: bool = True) -> Column:
    """Standard error from leave-one-out values; of score tests with the population variance, of REML with that of a sample. Null below two."""
    n = F.count(value)
    return F.when(n >= 2, F.sqrt((F.var_pop(value) if population else F.var_samp(value)) * (n - 1)))


def score_test(rows: DataFrame, annotations: list[str]) -> DataFrame:
    """score, SE, z and log10 p of each annotation: leave-one-out jackknife with population variance."""
    loo = leave_one_out(block_scores(rows, annotations), "store", "annotation")
    out = loo.groupBy("store", "annotation").agg(F.max("total").alias("score"), jackknife_error("loo").alias("se"))
    return _with_p(out, "store", "annotation")


def _with_p(out: DataFrame, *keys: str) -> DataFrame:
    z = F.when(F.col("se") > 0, F.try_divide(F.col("score"), F.col("se")))
    return out.select(*keys, "score", "se", z.alias("z")).withColumn("log10_p", log10_two_sided_p("z"))


def meta_analysis(rows: DataFrame, annotations: list[str]) -> DataFrame:
    """Scores of several stores combined by the inverse population variance of their leave-one-out scores.

    Every store must have two runs at least; one whose leave-one-out scores are all equal has no weight and makes the result null.
    """
    loo = leave_one_out(block_scores(rows, annotations), "store", "annotation")
    few = F.assert_true(F.count(F.lit(1)) >= 2, F.lit("a store needs two jackknife blocks at least"))
    weight = loo.groupBy("store", "annotation").agg(F.try_divide(F.lit(1.0), F.var_pop("loo")).alias("w"), few.alias("_ok")).where("_ok is null").drop("_ok")
    joined = loo.join(weight, ["store", "annotation"])
    by_run = joined.groupBy("annotation", "run").agg(F.sum(F.col("w") * F.col("loo")).alias("loo"))
    score = joined.groupBy("store", "annotation").agg((F.max("w") * F.max("total")).alias("x")).groupBy("annotation").agg(F.sum("x").alias("score"))
    se = by_run.groupBy("annotation").agg(jackknife_error("loo").alias("se"))
    return _with_p(score.join(se, "annotation"), "annotation")


def gene_jackknife(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene_row, jackknife_block): the last variant block whose first gene is not after the gene; 0 before all.

    hits: (row_nr, jackknife_block, gene_row) of the genes that variants touch. Blocks are runs of rows; a run's
    border is its first row, and runs without any gene are passed over.
    """
    one = hits.select("row_nr", "jackknife_block").distinct().withColumn("store", F.lit(0))
    runs = run_ordinals(one, "jackknife_block", "row_nr", early=False).select("row_nr", "run")
    border = runs.groupBy("run").agg(F.min("row_nr").alias("row_nr")).where("run > 0")
    first = border.join(hits.groupBy("row_nr").agg(F.min("gene_row").alias("gene_row")), "row_nr").groupBy("gene_row").agg(F.max("run").alias("run"))
    upto = Window.orderBy("gene_row").rowsBetween(Window.unboundedPreceding, 0)  # one row a gene of the gene table
    return genes.select("gene_row").join(first, "gene_row", "left").select("gene_row", F.coalesce(F.max("run").over(upto), F.lit(0)).alias("jackknife_block"))


def jackknife_groups(blocks: DataFrame, n: int) -> DataFrame:
    """Contiguous groups of blocks; the first ones are larger by one where n doesn't divide. The catalog is ordered as a whole: it has one row a block."""
    return blocks.withColumn("jk", (F.ntile(n).over(Window.orderBy("chrom", "chromStart")) - 1).cast("int"))


def enrichment(rows: DataFrame, annotations: list[str]) -> DataFrame:
    """Heritability sum(a * h2), size sum(a) and enrichment relative to the first annotation."""
    sums = rows.agg(*[F.sum(F.col(a) * F.col("h2")).alias(f"h_{a}") for a in annotations], *[F.sum(a).alias(f"n_{a}") for a in annotations])
    first = annotations[0]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("annotation"), F.col(f"h_{a}").alias("heritability"), F.col(f"n_{a}").cast("double").alias("size"), (F.try_divide(F.col(f"h_{a}"), F.col(f"h_{first}")) / F.try_divide(F.col(f"n_{a}"), F.col(f"n_{first}"))).alias("enrichment")) for a in annotations])).alias("x")).select("x.*")


#: Columns of a tile, and rows of a slab of it.
TILE, SLAB = 512, 256


def genotype_correlation(rows: DataFrame, column: str, tile: int = TILE, slab: int = SLAB) -> DataFrame:
    """(i, j, r) for all pairs i < j of the numbers in an array column; nan where a column does not vary.

    Columns are cut into tiles and rows into slabs. A pair of tiles meets in one task, slab after slab, which holds one product of tile * tile
    numbers and yields rows; each slab is sent to the pairs of its tile, and nothing of the size of the whole matrix is held anywhere.
    """
    sizes = rows.where(F.col(column).isNotNull()).agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError("the arrays differ in length")
    width = sizes.most or 0
    tiles = max(1, -(-width // tile))
    cells = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("slab", pa.string()), ("side", pa.int32()), ("n", pa.int32()), ("x", pa.binary())])

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                x = np.array(batch.column(0).slice(at, slab).to_pylist(), float)
                out: dict[str, list] = {n: [] for n in cells.names}
                for own in range(tiles):
                    raw = np.ascontiguousarray(x[:, own * tile : (own + 1) * tile]).tobytes()
                    for other in range(tiles):
                        for a, b, side in ([(own, other, 0)] if own <= other else []) + ([(other, own, 1)] if other <= own else []):
                            for n, v in zip(out, (a, b, f"{part}-{nth}", side, len(x), raw), strict=True):
                                out[n].append(v)
                nth += 1
                yield pa.RecordBatch.from_pydict(out, schema=cells)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, left = None, None, None
        for batch in batches:
            for a, b, _, side, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw).reshape(n, -1)
                if (a, b) != now:
                    if now:
                        yield from _pairs(now, sums, tile)
                    now, sums = (a, b), None
                if side == 0:
                    left = x
                    continue
                part = [len(x), left.sum(0), x.sum(0), (left * left).sum(0), (x * x).sum(0), left.T @ x]
                sums = part if sums is None else [s + p for s, p in zip(sums, part, strict=True)]
        if now:
            yield from _pairs(now, sums, tile)

    full = rows.select(F.col(column).cast("array<double>")).where(F.col(column).isNotNull())
    dealt = full.mapInArrow(slabs, "a int, b int, slab string, side int, n int, x binary").repartition("a", "b").sortWithinPartitions("a", "b", "slab", "side")
    return dealt.mapInArrow(products, "i int, j int, r double")


def _pairs(at: tuple[int, int], sums: list, tile: int) -> Iterator[pa.RecordBatch]:
    """Correlations of a pair of tiles from sums of values, squares and products."""
    n, sx, sy, xx, yy, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * xy - np.outer(sx, sy)) / np.sqrt(np.outer(n * xx - sx * sx, n * yy - sy * sy))
    for k in range(len(sx)):
        i = at[0] * tile + k
        j = at[1] * tile + np.arange(len(sy))
        yield pa.RecordBatch.from_pydict({"i": np.full((j > i).sum(), i, np.int32), "j": j[j > i].astype(np.int32), "r": r[k][j > i]})
