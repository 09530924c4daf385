"""Joins of the genetics tables: blocks, ranges, alleles, nearest genes, gene sets, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.scalars import allele_phase, chromosome, phased_frequency
from blockweave.operators.lineage import cut
from blockweave.operators.ordering import last_before, numbered

#: A range table is broadcast up to this many rows.
BROADCAST_ROWS = 50_000
#: Bits by which the bin widths of range lengths differ: a range covers two bins of its width at most.
LEVEL_BITS = 4


def first_present(df: DataFrame, *names: str) -> str:
    """The first of some column names that a table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} among {df.columns}")


def range_join(points: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Points (chrom, pos) with half-open ranges (chrom, start, end) on the same chromosome.

    A range goes to the bins of its own width class that it touches, two at most; a point looks into its bin of
    each width class that occurs. So work follows matches, however long, short or dense ranges are,
    and the join is an equi join that Spark broadcasts, sorts or splits. ``chrom`` may be any key; positions may be fractions.
    ``how``: inner, or left_semi for the points that lie in any range (each row once if points are distinct).
    """
    shift = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double")) / LEVEL_BITS).cast("int") * LEVEL_BITS
    sized = ranges.where("end > start").withColumn("_level", shift)
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("_level")).alias("levels")).first()  # 16 levels at most
    wide = lambda c: F.expr(f"shiftright({c}, _level)")
    r = sized.withColumn("_bin", F.explode(F.expr("array_distinct(array(shiftright(cast(floor(start) as bigint), _level), shiftright(cast(ceil(end) - 1 as bigint), _level)))"))).withColumnsRenamed({"chrom": "_chrom", "_level": "_rlevel", "_bin": "_rbin"})
    if stats.n <= BROADCAST_ROWS:
        r = F.broadcast(r)
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in stats.levels or [0]]).cast("array<int>"))).withColumn("_bin", wide("cast(floor(pos) as bigint)"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    out = p.join(r, (F.col("chrom") == F.col("_chrom")) & (F.col("_level") == F.col("_rlevel")) & (F.col("_bin") == F.col("_rbin")) & inside, how).drop("_level", "_bin", "_rlevel", "_rbin", "_chrom")
    return out.distinct() if how == "left_semi" else out


def partition_variants(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """Variants with the block they lie in; overlapping blocks repeat them, those outside all vanish.

    Chromosomes may be written 7 or chr7 on either side.
    """
    ranges = blocks.select("block_id", chromosome(F.col("chrom")).alias("chrom"), F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"))
    points = variants.withColumn("_written", F.col("CHR")).withColumn("CHR", chromosome(F.col("CHR"))).withColumnRenamed("CHR", "chrom")
    return range_join(points, ranges).drop("start", "end", "chrom").withColumnRenamed("_written", "CHR")  # column names ignore case: pos is POS


def partition_by_block(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``partition_variants`` for all blocks of a catalog: one row a block, its variants in order of position, none as an empty list."""
    inside = partition_variants(variants, blocks)
    fields = ["POS", *[c for c in variants.columns if c != "POS"]]
    lists = inside.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("variants"))
    return blocks.join(lists, "block_id", "left").withColumn("variants", F.coalesce("variants", F.array().cast(lists.schema["variants"].dataType)))


def annotate_ranges(variants: DataFrame, ranges: DataFrame, name: str = "annotated") -> DataFrame:
    """Variants with a flag: whether any range (chrom, start, end) covers them. Ranges must not be empty. Chromosomes may be written 7 or chr7 on either side."""
    checked = ranges.withColumn("_ok", F.assert_true(F.col("end") > F.col("start"), F.lit("a range must end after its start"))).where("_ok is null").drop("_ok")
    placed = variants.withColumn("_chrom", chromosome(F.col("CHR")))
    points = placed.select(F.col("_chrom").alias("chrom"), F.col("POS").alias("pos")).distinct()
    hit = range_join(points, checked.select(chromosome(F.col("chrom")).alias("chrom"), "start", "end"), "left_semi").select(F.col("chrom").alias("_chrom"), F.col("pos").alias("POS"), F.lit(True).alias(name))
    return placed.join(hit, ["_chrom", "POS"], "left").select(*variants.columns, F.coalesce(name, F.lit(False)).alias(name))


def merge_snplists(info: DataFrame, sumstats: DataFrame, by: str = "SNP", extra: tuple[str, ...] = (), signed: tuple[str, ...] = ("Z",)) -> DataFrame:
    """Variant rows of each block with their summary statistics.

    Statistics that carry a block_id (from ``partition_variants``) meet the variants of their own block only.
    Keys are compared null-safe. Rows whose alleles differ go; swapped alleles flip the signed columns, an
    unknown phase makes them null. Result: new dense node index, first row of each node marked.
    """
    name_of = lambda c: f"{c}_sumstats" if c in info.columns else c
    left_key = "site_ids" if by == "SNP" else "position"
    block = [F.col("block_id").alias("_block")] if "block_id" in sumstats.columns else []
    right = sumstats.select(F.col(by).alias("_key"), F.col("REF").alias("_ref"), F.col("ALT").alias("_alt"), F.col("row_nr").alias("sumstat_row"), *block, *[F.col(c).alias(name_of(c)) for c in (*signed, *extra)])
    same = info[left_key].eqNullSafe(right["_key"])
    both = info.join(right, same & (info["block_id"] == right["_block"]) if block else same).withColumn("phase", allele_phase(F.col("anc_alleles"), F.col("deriv_alleles"), F.col("_ref"), F.col("_alt"))).where("phase <> 0 or phase is null")
    for c in signed:
        both = both.withColumn(name_of(c), F.col(name_of(c)) * F.col("phase"))
    node = Window.partitionBy("block_id", "index").orderBy("row_nr", "sumstat_row")
    order = Window.partitionBy("block_id").orderBy("index")
    return both.withColumn("is_representative", F.row_number().over(node) == 1).withColumn("node", (F.dense_rank().over(order) - 1).cast("int")).drop("_key", "_ref", "_alt", "_block")


def merge_first_match(info: DataFrame, sumstats: DataFrame, weights: str | None = None, af_tolerance: float | None = None) -> DataFrame:
    """Merge that takes the first row only of a repeated variant on either side, by (block_id, SNP).

    Z is that of the table, or BETA / SE where it has none. ``weights`` names a column of per-allele
    weights, which is summed over the variants of a node. ``af_tolerance`` drops variants whose allele
    frequencies (AF in the statistics, af in the list, flipped with the alleles) differ by as much or more.
    """
    first = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_nr"))).where("_n = 1").drop("_n")
    z = F.col("Z") if "Z" in sumstats.columns else F.try_divide(F.col("BETA"), F.col("SE"))
    right = first(sumstats, "block_id", "SNP").select(F.col("block_id").alias("_block"), F.col("SNP").alias("_snp"), F.col("REF").alias("_ref"), F.col("ALT").alias("_alt"), F.col("row_nr").alias("sumstat_row"), z.alias("z"), *([F.col("AF").alias("_af")] if af_tolerance is not None else []), *([F.col(weights).alias("_w")] if weights else []))
    both = first(info, "block_id", "site_ids").join(right, (F.col("block_id") == F.col("_block")) & (F.col("site_ids") == F.col("_snp")))
    both = both.withColumn("phase", allele_phase(F.col("anc_alleles"), F.col("deriv_alleles"), F.col("_ref"), F.col("_alt"))).where("phase <> 0").withColumn("z", F.col("z") * F.col("phase"))
    if af_tolerance is not None:
        both = both.where(F.abs(F.col("af") - phased_frequency(F.col("phase"), F.col("_af"))) < af_tolerance)
    if weights:
        both = both.withColumn("weight", F.sum(F.col("_w") * F.col("phase")).over(Window.partitionBy("block_id", "index")))
    node = Window.partitionBy("block_id", "index").orderBy("row_nr")
    return both.withColumn("is_representative", F.row_number().over(node) == 1).drop("_block", "_snp", "_ref", "_alt", "_af", "_w")


def merge_panels(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full join of two reference panels (SNP, REF, ALT, genotypes as an array of 0 to 2) with aligned alleles.

    provenance: 0 both, 1 left only, 2 right only. Individuals of a panel without the variant get the
    other panel's mean. Variants with other alleles than the left panel's count as missing on the right.
    """
    size = lambda df: df.agg(F.max(F.size("genotypes")).alias("n"))
    r = right.select("SNP", F.col("REF").alias("_ref"), F.col("ALT").alias("_alt"), F.col("genotypes").alias("_g"))
    both = left.join(r, "SNP", "full").withColumn("phase", F.when(F.col("REF").isNull(), 1).otherwise(allele_phase(F.col("REF"), F.col("ALT"), F.col("_ref"), F.col("_alt"))))
    other = F.when(F.col("phase") == 1, F.col("_g")).when(F.col("phase") == -1, F.transform("_g", lambda x: 2 - x))
    both = both.withColumn("_g", other).join(F.broadcast(size(left).withColumnRenamed("n", "_nl"))).join(F.broadcast(size(right).withColumnRenamed("n", "_nr")))  # one row each
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    filled = lambda own, given, n: F.coalesce(F.col(own).cast("array<double>"), F.array_repeat(mean(F.col(given).cast("array<double>")), F.col(n).cast("int")))
    provenance = F.when(F.col("genotypes").isNull(), 2).when(F.col("_g").isNull(), 1).otherwise(0)
    return both.select("SNP", F.coalesce("REF", "_ref").alias("REF"), F.coalesce("ALT", "_alt").alias("ALT"), F.concat(filled("genotypes", "_g", "_nl"), filled("_g", "genotypes", "_nr")).alias("genotypes"), provenance.alias("provenance"))


def common_nodes(selections: DataFrame) -> DataFrame:
    """(block_id, i) of the nodes that the selection (population, block_id, i, ord) of every population holds, in the order of the first."""
    populations = selections.select("population").distinct()
    first = populations.agg(F.min("population").alias("first"), F.count(F.lit(1)).alias("n"))
    kept = selections.join(F.broadcast(first)).groupBy("block_id", "i").agg(F.countDistinct("population").alias("k"), F.max("n").alias("n"), F.min(F.when(F.col("population") == F.col("first"), F.col("ord"))).alias("ord")).where("k = n")
    return kept.select("block_id", "i", (F.row_number().over(Window.partitionBy("block_id").orderBy("ord")) - 1).alias("ord"))


def _line(df: DataFrame) -> Column:
    """Global position; positions are below 1e9."""
    return (chromosome(F.col("CHR")).cast("long") * F.lit(10**9) + F.col("POS")).cast("long")


def nearest_genes(variants: DataFrame, genes: DataFrame, weights: list[float]) -> DataFrame:
    """The len(weights) nearest genes of each variant with their weight, by global position.

    Positions are chrom * 1e9 + pos; ties go to the earlier gene row. Genes are numbered along the line; each has with it the 2 k genes up to it and
    the 2 k behind it, and a position takes those of the last gene at or before it, which the order carries to it, and ranks them in its own row.
    So work is 4 k genes a position, wherever genes and variants lie, and positions are dealt evenly, however many follow one gene.
    Of genes at one position only the first k can be among the nearest.
    """
    k = len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])
    same = Window.partitionBy("at").orderBy("gene_row")
    line = genes.select(_line(genes).alias("at"), "gene_id", "gene_row").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    line = cut(numbered(line, ["at", "gene_row"], "nr"))
    around = line.select(F.explode(F.sequence(F.greatest(F.col("nr") - 2 * k, F.lit(-1)), F.col("nr") + 2 * k - 1)).alias("nr"), F.struct("at", "gene_row", "gene_id").alias("gene")).groupBy("nr").agg(F.collect_list("gene").alias("near"))
    last = line.groupBy("at").agg(F.max("nr").alias("nr")).select(F.col("at").alias("g"), "nr")
    first = around.where("nr = -1").select(F.lit(-(2**62)).cast("long").alias("g"), "near")  # for positions before all genes
    centres = last.join(around, "nr").select("g", "near").unionByName(first).select("g", F.lit(0).alias("point"), "near")
    points = variants.select(_line(variants).alias("g")).where("g is not null").distinct().select("g", F.lit(1).alias("point"), F.lit(None).cast(centres.schema["near"].dataType).alias("near"))
    placed = last_before(centres.unionByName(points), ["g", "point"], F.col("near"), "own").where("point = 1")
    ranked = placed.select("g", F.slice(F.sort_array(F.transform("own", lambda x: F.struct(F.abs(x["at"] - F.col("g")).alias("away"), x["gene_row"].alias("gene_row"), x["gene_id"].alias("gene_id")))), 1, k).alias("own"))
    found = ranked.select("g", F.posexplode("own").alias("rank", "gene")).select("g", F.col("gene.gene_id").alias("gene_id"), "rank", F.element_at(w, F.col("rank") + 1).alias("weight"))
    return variants.withColumn("g", _line(variants)).join(found, "g").drop("g")


def gene_scores(near: DataFrame, values: list[str]) -> DataFrame:
    """Values of variants carried to genes: sum(weight * value) for each of ``values``, from rows of ``nearest_genes``."""
    return near.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])


def gene_set_variants(near: DataFrame, members: DataFrame) -> DataFrame:
    """(row_nr, set_name, weight): a variant's weight in a gene set, summed over its near genes (``gene_set_annotations``)."""
    return near.join(members, "gene_id").groupBy("row_nr", "set_name").agg(F.sum("weight").alias("weight"))


def gene_set_annotations(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """(gene_id, set_name) of every gene that a set names; by gene_id if the first gene named contains ENSG, else by gene_name."""
    first = sets.agg(F.min(F.struct(*[c for c in ("set_row", "set_name") if c in sets.columns], "gene")).alias("x")).select(F.col("x.gene").contains("ENSG").alias("_by_id"))
    distinct = sets.select("set_name", "gene").distinct().join(F.broadcast(first))  # one row
    # each gene under both of its names, so that the join is one of equal keys
    named = genes.select("gene_id", F.explode(F.array(F.struct(F.lit(True).alias("_by_id"), F.col("gene_id").alias("gene")), F.struct(F.lit(False).alias("_by_id"), F.col("gene_name").alias("gene")))).alias("x")).select("gene_id", "x.*")
    return named.join(distinct.withColumn("_by_id", F.coalesce("_by_id", F.lit(False))), ["_by_id", "gene"]).select("gene_id", "set_name").distinct()


def match_annotations(rows: DataFrame, annotations: DataFrame, by: str | None = None) -> DataFrame:
    """Score rows with their annotations; inner by a key that the annotations must not repeat.

    ``by`` None: the first of RSID, gene_id, gene_name and SNP that both have.
    """
    key = by or next((c for c in ("RSID", "gene_id", "gene_name", "SNP") if c in rows.columns and c in annotations.columns), None)
    if key is None:
        raise ValueError("score rows and annotations have no key in common")
    counted = annotations.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    checked = counted.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("annotations repeat the key "), F.col(key).cast("string")))).where("_ok is null")
    keep = [c for c in annotations.columns if c == key or c not in rows.columns]
    return rows.join(checked.select(*keep), key)


def first_cover(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct points (chrom, pos) with the smallest ``value`` of the half-open ranges (chrom, start, end, value) that cover them; those outside all vanish.

    Ends of ranges are numbered along the line, and a range falls into dyadic stretches of these numbers, two of a length at most. A stretch keeps its
    smallest value, and a point looks into the one stretch of each length that it lies in. So a point costs the lengths that occur, 2 log n at
    most, however many ranges cover it; no pair of a point and a range is ever made.
    """
    once = ranges.where("end > start").groupBy("chrom", "start", "end").agg(F.min("value").alias("value"))
    line = cut(numbered(once.select("chrom", F.explode(F.array("start", "end")).alias("pos")).distinct(), ["chrom", "pos"], "nr"))
    side = lambda end, nr: line.withColumnsRenamed({"pos": end, "nr": nr})
    placed = once.join(side("start", "a"), ["chrom", "start"]).join(side("end", "b"), ["chrom", "end"])
    sized = placed.withColumn("level", F.explode(F.expr("sequence(0, cast(floor(log2(b - a)) as int))")))
    ends = sized.select("level", "value", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)").alias("l"), F.expr("shiftright(b, level)").alias("r")).where("l < r")
    parts = F.expr("array_compact(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)))")
    stretches = cut(ends.withColumn("stretch", F.explode(parts)).groupBy("level", "stretch").agg(F.min("value").alias("value")))
    stats = stretches.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("level")).alias("levels")).first()  # 64 levels at most
    marks = line.select("chrom", "pos", F.lit(0).alias("point"), "nr")
    asked = points.select("chrom", "pos").distinct().select("chrom", "pos", F.lit(1).alias("point"), F.lit(None).cast("long").alias("nr"))
    at = last_before(marks.unionByName(asked), ["chrom", "pos", "point"], F.col("nr"), "at").where("point = 1")
    looks = at.withColumn("level", F.explode(F.array(*[F.lit(x) for x in stats.levels or [0]]))).select("chrom", "pos", "level", F.expr("shiftright(at, level)").alias("stretch"))
    return looks.join(F.broadcast(stretches) if stats.n <= BROADCAST_ROWS else stretches, ["level", "stretch"]).groupBy("chrom", "pos").agg(F.min("value").alias("value"))


def mutations_to_bricks(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """The first edge, in table order, that carries each mutation: child = node, left <= position < right.

    The child takes the chromosome's place (``first_cover``), so a node's many edges over one place cost no more than one.
    """
    points = mutations.select("mutation", F.col("node").alias("chrom"), F.col("position").alias("pos"))
    hit = points.join(first_cover(points, edges.select(F.col("child").alias("chrom"), F.col("left").alias("start"), F.col("right").alias("end"), F.col("brick").alias("value"))), ["chrom", "pos"])
    return hit.groupBy("mutation").agg(F.min(F.struct(F.col("value").alias("brick"), "pos")).alias("x")).select("mutation", F.col("x.pos").alias("position"), "x.brick")


def reml_join(sumstats: DataFrame, annotations: DataFrame, keep_annotations: bool = False, by: tuple[str, ...] = ("SNP",)) -> DataFrame:
    """Summary statistics with annotations by SNP, or by (CHR, POS); the first row of each repeated key stays.

    CHR and POS are those of the annotations. ``keep_annotations``: annotated variants without statistics stay too.
    """
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("row_nr"))).where("_n = 1").drop("_n")
    right = first(annotations)
    taken = [c for c in ("SNP", "REF", "ALT", "Z", "N") if c in by or c not in annotations.columns]
    left = first(sumstats).select(*dict.fromkeys((*by, *taken)))
    return left.join(right, list(by), "right" if keep_annotations else "inner")
