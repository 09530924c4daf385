"""Readers of the genetics formats: distributed text, CSV and Parquet scans with explicit columns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions.scalars import is_finite
from blockweave.operators.joins import annotate_ranges, first_present
from blockweave.operators.precision import normalise, sparse_precision

# ---- files and lines


def files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Sorted paths of a folder's files whose names match a glob, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(s.getPath().toString()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]  # a folder may be a table in parts
    return sorted(f for f in found if fnmatch.fnmatchcase(f.rsplit("/", 1)[-1], pattern))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, nr, value): lines with their place in their file from 0. A task numbers one split; splits know how many lines lie before them."""
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    counts = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "at", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "at").orderBy("id"))
    return lines.withColumn("k", inside).join(F.broadcast(before), ["file", "at"]).select("file", (F.col("before") + F.col("k") - 1).alias("nr"), "value")  # one row a split


def source(spark: SparkSession, what: DataFrame | str | Callable[[SparkSession, list[str]], DataFrame], columns: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Columns of a DataFrame, a table, a query in parentheses, or of what a function (spark, columns) returns.

    ``rename`` maps a wanted name to that of the source; only these columns are read.
    """
    names = rename or {}
    if callable(what) and not isinstance(what, DataFrame):
        df = what(spark, [names.get(c, c) for c in columns])
    elif isinstance(what, str):
        df = spark.sql(what.strip()[1:-1]) if what.strip().startswith("(") else spark.table(what)
    else:
        df = what
    if lacking := [names.get(c, c) for c in columns if names.get(c, c) not in df.columns]:
        raise ValueError(f"the source lacks {lacking}")
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in columns])


#: Columns that a table of each kind has to have; one of each tuple.
CONTRACTS = {
    "summary statistics": ["SNP", "CHR", "POS", "REF", "ALT", "Z"],
    "annotations": [("SNP", "RSID", "gene_id"), ("CHR", "chrom", "chromosome"), ("POS", "BP", "position")],
    "block catalog": ["chrom", "chromStart", "chromEnd", "name", "snplistName"],
    "variant scores": ["RSID", "CHR", "POS", "jackknife_block"],
    "gene scores": ["gene_id", "gene_name", "CHR", "POS", "jackknife_block"],
}


def assert_contract(df: DataFrame, kind: str) -> DataFrame:
    """The table, if it has what its kind has to have; statistics must be finite where there are any."""
    for c in CONTRACTS[kind]:
        names = (c,) if isinstance(c, str) else c
        if not set(names) & set(df.columns):
            raise ValueError(f"{kind}: no column {' or '.join(names)}")
    if kind == "summary statistics":
        wrong = F.col("Z").isNull() | ~is_finite(F.col("Z").cast("double"))
        return df.withColumn("_ok", F.assert_true(~wrong, F.lit("Z must be finite"))).where("_ok is null").drop("_ok")
    return df


def annotation_columns(df: DataFrame, reserved: tuple[str, ...] = ("SNP", "RSID", "CHR", "chrom", "chromosome", "POS", "BP", "position", "CM", "REF", "ALT", "A1", "A2", "row_nr", "gene_id", "gene_name", "midpoint")) -> list[str]:
    """Numeric and boolean columns that are no keys."""
    return [n for n, t in df.dtypes if n not in reserved and (t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]


# ---- edge lists, variant lists, catalogs


def read_edgelist(spark: SparkSession, path: str | list[str], zero_weight: float | None = None, symmetrise: bool = False) -> DataFrame:
    """Headerless CSV of zero-based (i, j, value). ``zero_weight`` takes the place of zeros; ``symmetrise`` keeps one entry a pair and mirrors it."""
    df = spark.read.csv(path, schema="i int, j int, value double")
    if zero_weight is not None:
        df = df.withColumn("value", F.when(F.col("value") == 0, F.lit(float(zero_weight))).otherwise(F.col("value")))
    if symmetrise:
        once = df.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("value").alias("value"))
        df = once.union(once.where("i <> j").select("j", "i", "value"))
    return df


_LIST_TYPES = {"index": "int", "position": "long", "anc_alleles": "string", "deriv_alleles": "string", "site_ids": "string", "swap": "string", "file": "string"}


def read_snplist(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variant list with a header; columns of unknown names are frequencies. One scan: only the header is looked at before."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.col(c).cast(_LIST_TYPES.get(c, "double")).alias(c) for c in df.columns])


def snplist_of(prefix: str, names: list[str]) -> str:
    """The first of sorted file names that starts with the prefix and ends in .snplist."""
    found = [n for n in sorted(names) if re.match(re.escape(prefix) + r".*\.snplist$", n.rsplit("/", 1)[-1])]
    if not found:
        raise ValueError(f"no variant list begins with {prefix}")
    return found[0]


def block_catalog(table: DataFrame, population: str | None = None, populations: list[str] | None = None, chromosomes: list[int] | None = None) -> DataFrame:
    """Catalog rows of some populations and chromosomes, in order of chrom and chromStart; none left is an error."""
    assert_contract(table, "block catalog")
    wanted = populations or ([population] if population else None)
    if wanted is not None and "population" in table.columns:
        table = table.where(F.col("population").isin(*wanted))
    if chromosomes is not None:
        table = table.where(F.col("chrom").isin(*chromosomes))
    if not table.take(1):
        raise ValueError("no block is left in the catalog")
    return table.orderBy("chrom", "chromStart")


def read_block_catalog(spark: SparkSession, path: str, **filters) -> DataFrame:
    df = spark.read.csv(path, header=True, comment="#")
    types = {"chrom": "int", "chromStart": "long", "chromEnd": "long", "numVariants": "int", "numIndices": "int", "numEntries": "int"}
    return block_catalog(df.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in df.columns]), **filters)


def load_blocks(spark: SparkSession, catalog: DataFrame, folder: str, population: str | None = None, snps_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matrices (block_id, i, j, value) and variants of a catalog's files, each kind in a single scan.

    A block is named by its edge list. Nodes without a diagonal entry go, the others are numbered anew from 0; original_index keeps the old number. The
    frequency column is that of the block's population, as af.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]+)\.(?:edgelist|snplist)(?:/|$)", 1)
    rows = catalog.select("name", "snplistName", *(["population"] if "population" in catalog.columns else [])).collect()  # one row a block
    named = spark.createDataFrame([(r["name"].removesuffix(".edgelist"), r["snplistName"].removesuffix(".snplist"), population or (r["population"] if "population" in r.__fields__ else None)) for r in rows], "block_id string, list string, population string")
    edges = read_edgelist(spark, [f"{folder}/{r['name']}" for r in rows]).withColumn("block_id", base(F.input_file_name()))
    lists = read_snplist(spark, sorted({f"{folder}/{r['snplistName']}" for r in rows})).withColumn("list", base(F.input_file_name()))
    entries = edges.join(F.broadcast(named.select("block_id")), "block_id")  # one row a block
    nodes = entries.where("i = j and value <> 0").select("block_id", "i").distinct().withColumn("node", (F.row_number().over(Window.partitionBy("block_id").orderBy("i")) - 1).cast("int"))
    at = lambda old, new: nodes.select("block_id", F.col("i").alias(old), F.col("node").alias(new))
    kept = entries.join(at("i", "ni"), ["block_id", "i"]).join(at("j", "nj"), ["block_id", "j"]).select("block_id", F.col("ni").alias("i"), F.col("nj").alias("j"), "value")
    matrix = sparse_precision(kept)

    known = [c for c in lists.columns if c not in _LIST_TYPES and c != "list"]
    af = F.coalesce(*[F.when(F.col("population") == c, F.col(c)) for c in known if c != "af"], *([F.col("af")] if "af" in known else []), F.lit(None).cast("double"))
    variants = lists.join(F.broadcast(named), "list").withColumn("af_", af).join(nodes.withColumnRenamed("i", "index"), ["block_id", "index"])
    if snps_only:
        variants = variants.where("length(anc_alleles) = 1 and length(deriv_alleles) = 1")
    order = Window.partitionBy("block_id").orderBy("node", "position", "site_ids")
    return matrix, variants.select("block_id", (F.row_number().over(order) - 1).cast("long").alias("row_nr"), F.col("node").alias("index"), F.col("index").alias("original_index"), "site_ids", "position", "anc_alleles", "deriv_alleles", F.col("af_").alias("af"))


def load_populations(spark: SparkSession, catalog: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """As ``load_blocks`` for all populations of a catalog: single-letter alleles only, matrices whose inverse has a diagonal of ones, and the
    frequency of the first variant of each node."""
    matrix, variants = load_blocks(spark, catalog, folder, snps_only=True)
    first = F.first("af").over(Window.partitionBy("block_id", "index").orderBy("row_nr"))
    return normalise(matrix), variants.withColumn("af", first)


def parse_adjacency(lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Upper triangle (i, j, value) of lines ``a b {'weight': w}``, with names mapped to the index of variants (site_ids, index); six digits."""
    got = lines.select(F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)", 1).alias("a"), F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)", 2).alias("b"), F.regexp_extract("value", r"'weight':\s*([-+0-9.eE]+)", 1).try_cast("double").alias("w")).where("w is not null")
    named = lambda old, new: variants.select(F.col("site_ids").alias(old), F.col("index").alias(new))
    both = got.join(named("a", "ia"), "a").join(named("b", "ib"), "b")
    return both.groupBy(F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j")).agg(F.bround(F.max("w"), 6).alias("value"))


def parse_genotypes(lines: DataFrame) -> DataFrame:
    """(row, variant, value) of genotype or correlation lines (nr, value): digits side by side, or numbers between blanks or commas."""
    text = F.trim("value")
    parts = F.when(text.rlike(r"[\s,]"), F.split(text, r"[\s,]+")).otherwise(F.split(text, ""))
    return lines.where(text != "").select(F.col("nr").alias("row"), F.posexplode(F.filter(parts, lambda x: x != "")).alias("variant", "v")).select("row", "variant", F.col("v").cast("double").alias("value"))


# ---- ranges, annotations, genes

_BED = {"chrom": "string", "chromStart": "long", "chromEnd": "long", "name": "string", "score": "double", "strand": "string", "thickStart": "long", "thickEnd": "long", "itemRgb": "string", "blockCount": "int", "blockSizes": "string", "blockStarts": "string"}


def parse_bed(lines: DataFrame, min_fields: int = 3, max_fields: int = 12, zero_based: bool = True) -> DataFrame:
    """BED lines (column value) with up to ``max_fields`` typed columns. One-based input has 1 added to the starts.

    Comments, track and browser lines are passed over; lines must have the fields of the longest one at most and min_fields at least.
    """
    v = F.trim("value")
    parts = F.split(v, "\\s+")
    kept = lines.where((v != "") & ~v.rlike("^(#|browser|track)")).select(parts.alias("f"))
    fine = F.assert_true(F.size("f").between(min_fields, max_fields), F.concat(F.lit("a BED line has "), F.size("f").cast("string"), F.lit(" fields")))
    shift = lambda n, c: c + 1 if not zero_based and n in ("chromStart", "thickStart") else c
    cells = [shift(n, F.try_element_at("f", F.lit(k + 1)).cast(t)).alias(n) for k, (n, t) in enumerate(list(_BED.items())[:max_fields])]
    return kept.withColumn("_ok", fine).where("_ok is null").select(*cells)


def parse_annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """One kind of annotation files (tab or blank separated, same header in all): file, nr from 0 and their columns."""
    lines = numbered_lines(spark, *paths)
    header = {r.file: re.split(r"\s+", r.value.strip()) for r in lines.where("nr = 0").collect()}  # one line a file
    out = None
    for names in dict.fromkeys(map(tuple, header.values())):
        part = lines.where(F.col("file").isin(*[f for f, h in header.items() if tuple(h) == names]) & (F.col("nr") > 0) & (F.trim("value") != ""))
        cells = F.when(F.col("nr") > 0, F.split(F.trim("value"), "\\s+"))  # a header is never cast, wherever a filter moves
        types = {"SNP": "string", "CHR": "int", "BP": "long", "POS": "long"}
        part = part.select("file", (F.col("nr") - 1).alias("nr"), *[F.element_at(cells, k + 1).cast(types.get(n, "double")).alias(n) for k, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load_annotations(spark: SparkSession, folder: str, chromosomes: list[int] | None = None, convert_binary: bool = True, bed_files: list[str] | None = None) -> DataFrame:
    """Annotations of files <stem>.<chromosome>.annot: stems are bound by row within a chromosome, chromosomes one after another.

    Of a column that several files of a chromosome have, the first file's (by name) holds. Columns that hold 0 and 1 only, and both of
    them, become boolean. Each of ``bed_files`` (default: the folder's) adds a column, named like the file: 1 where a range covers the variant.
    """
    by_stem: dict[str, list[str]] = {}
    for f in files(spark, folder, "*.annot"):
        m = re.match(r"(.*)\.(\d+)\.annot$", f.rsplit("/", 1)[-1])
        if m and (chromosomes is None or int(m[2]) in chromosomes):
            by_stem.setdefault(m[1], []).append(f)
    if not by_stem:
        raise ValueError(f"no annotation files in {folder}")
    out = None
    for stem in sorted(by_stem):
        part = parse_annotations(spark, *by_stem[stem]).withColumn("_chr", F.regexp_extract("file", r"\.(\d+)\.annot(?:/|$)", 1).cast("int")).drop("file")
        if out is None:
            out = part
            continue
        fresh = [c for c in part.columns if c not in out.columns]
        both = out.join(part.select("_chr", "nr", F.lit(True).alias("_there"), *fresh), ["_chr", "nr"], "full")
        same = F.assert_true(F.col("_there").isNotNull() & F.col(out.columns[1] if out.columns[0] == "nr" else out.columns[0]).isNotNull(), F.lit("annotation files of a chromosome have different numbers of rows"))
        out = both.withColumn("_ok", same).where("_ok is null").drop("_ok", "_there")
    keys = ("CHR", "BP", "POS", "SNP", "CM")
    values = [c for c in out.columns if c not in (*keys, "_chr", "nr")]
    if convert_binary and values:
        ends = out.agg(*[F.array(F.min(c), F.max(c), F.coalesce(F.sum((~F.col(c).isin(0.0, 1.0)).cast("double")), F.lit(0.0))).alias(c) for c in values]).first()
        binary = [c for c in values if list(ends[c]) == [0.0, 1.0, 0.0]]
        out = out.select(*[(F.col(c) == 1).alias(c) if c in binary else F.col(c) for c in out.columns])
    out = out.withColumnRenamed("nr", "row_nr").drop("_chr")
    beds = files(spark, folder, "*.bed") if bed_files is None else bed_files
    for f in beds:
        name = f.rsplit("/", 1)[-1].removesuffix(".bed")
        ranges = parse_bed(spark.read.text(f)).select(F.regexp_replace("chrom", "(?i)^chr", "").cast("int").alias("chrom"), F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"))
        at = first_present(out, "POS", "BP", "position")
        flagged = annotate_ranges(out.withColumnRenamed(at, "POS") if at != "POS" else out, ranges, name)
        out = (flagged.withColumnRenamed("POS", at) if at != "POS" else flagged).withColumn(name, F.col(name).cast("double"))
    return out


_GENE_NAMES = {"Gene stable ID": "gene_id", "Gene stable ID version": "gene_id_version", "Gene name": "gene_name", "Gene start (bp)": "start", "Gene end (bp)": "end", "Chromosome/scaffold name": "CHR"}


def gene_table(table: DataFrame, chromosomes: list[int] | None = None) -> DataFrame:
    """Genes with midpoint and POS in order of chromosome and midpoint, numbered by gene_row; a missing name becomes NA."""
    df = table.withColumnsRenamed({k: v for k, v in _GENE_NAMES.items() if k in table.columns})
    df = df.withColumn("CHR", F.col("CHR").try_cast("int")).where("CHR is not null")
    if chromosomes is not None:
        df = df.where(F.col("CHR").isin(*chromosomes))
    mid = (F.col("start").cast("long") + F.col("end").cast("long")) / 2
    out = df.withColumn("midpoint", mid).withColumn("POS", F.floor(mid).cast("int")).withColumn("gene_name", F.coalesce("gene_name", F.lit("NA")))
    return out.withColumn("gene_row", F.row_number().over(Window.orderBy("CHR", "midpoint", "gene_id")).cast("long") - 1)  # a gene table is small


def read_gene_table(spark: SparkSession, path: str, chromosomes: list[int] | None = None) -> DataFrame:
    return gene_table(spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t"), chromosomes)


def parse_gmt(lines: DataFrame) -> DataFrame:
    """GMT lines: one row (set_name, description, gene) for each distinct gene of each set. Names must be there and differ."""
    parts = F.split("value", "\t")
    genes = F.array_distinct(F.filter(F.slice(parts, 3, 1 << 30), lambda g: F.trim(g) != ""))
    sets = lines.where(F.size(parts) >= 3).select(F.element_at(parts, 1).alias("set_name"), F.element_at(parts, 2).alias("description"), genes.alias("genes"))
    fine = F.assert_true((F.trim("set_name") != "") & (F.count(F.lit(1)).over(Window.partitionBy("set_name")) == 1), F.concat(F.lit("a set has no name, or twice that of "), F.col("set_name")))
    return sets.withColumn("_ok", fine).where("_ok is null").select("set_name", "description", F.explode("genes").alias("gene"))


# ---- summary statistics


def parse_vcf(lines: DataFrame, fields: list[str] | None = None, maximum_missingness: float = 0.1) -> DataFrame:
    """GWAS VCF lines with one sample: Z = ES / SE, finite rows with enough samples (NS).

    ``fields``: the names of FORMAT; without it those of the first body line count for all.
    """
    body = lines.where(~F.col("value").startswith("#"))
    if fields is None:
        first = (body.orderBy("nr") if "nr" in lines.columns else body).first()
        if first is None:
            raise ValueError("there is no line after the header")
        fields = vcf_fields(first.value)
    # a line is split once: an exploded array of one is not written into every expression that reads it
    cut_lines = body.select(F.explode(F.array(F.split("value", "\t"))).alias("_cols")).select("_cols", F.explode(F.array(F.split(F.try_element_at("_cols", F.lit(10)), ":"))).alias("_sample"))
    cols, sample = F.col("_cols"), F.col("_sample")
    one = F.assert_true(F.coalesce((F.size(cols) == 10) & (F.size(sample) == len(fields)), F.lit(False)), F.lit("a line must have one sample, and as many values as fields"))
    get = lambda name: F.element_at(sample, fields.index(name) + 1).try_cast("double") if name in fields else F.lit(None).cast("double")
    rows = cut_lines.withColumn("_ok", one).where("_ok is null").select(
        F.element_at(cols, 1).alias("CHR"), F.element_at(cols, 2).cast("long").alias("POS"), F.element_at(cols, 3).alias("SNP"), F.element_at(cols, 4).alias("REF"), F.element_at(cols, 5).alias("ALT"), F.try_divide(get("ES"), get("SE")).alias("Z"), get("NS").alias("N")
    )
    rows = rows.where(is_finite(F.col("Z")))
    most = rows.agg(F.max("N").alias("_most"))
    return rows.join(F.broadcast(most), F.col("_most").isNull() | (F.col("N") >= (1 - maximum_missingness) * F.col("_most"))).drop("_most")


def read_gwas_vcf(spark: SparkSession, path: str, num_rows: int | None = None, maximum_missingness: float = 0.1) -> DataFrame:
    """A VCF file; ``num_rows`` counts body lines before any filter."""
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("value").startswith("#")).agg(F.count(F.lit(1))).first()[0]
    if num_rows is not None:
        lines = lines.where(F.col("nr") < heads + num_rows)
    return parse_vcf(lines, None, maximum_missingness)


def vcf_fields(line: str) -> list[str]:
    """Field names of the first body line; unknown or missing ones are errors."""
    names = line.split("\t")[8].split(":")
    if extra := set(names) - {"ES", "SE", "LP", "NS", "EZ", "SI", "NC", "AF", "AC", "ID"}:
        raise ValueError(f"unknown FORMAT fields {sorted(extra)}")
    if missing := {"ES", "SE", "LP"} - set(names):
        raise ValueError(f"missing FORMAT fields {sorted(missing)}")
    return names


def parquet_traits(df: DataFrame) -> list[str]:
    """Traits that have both a _BETA and a _SE column; from the schema alone."""
    stems = lambda end: {c.removesuffix(end) for c in df.columns if c.endswith(end)}
    return sorted(stems("_BETA") & stems("_SE"))


#: Names under which a variant table may have each column; the first that is there is read.
ALIASES = {"SNP": ("SNP", "site_ids", "rsid", "RSID", "ID", "variant_id"), "CHR": ("CHR", "chrom", "chromosome", "#CHROM"), "POS": ("POS", "position", "BP", "pos"), "REF": ("REF", "ref", "anc_alleles", "A2"), "ALT": ("ALT", "alt", "deriv_alleles", "A1"), "N": ("N", "NS", "n")}


def read_parquet_sumstats(df: DataFrame, trait: str | None = None, maximum_missingness: float = 1.0) -> DataFrame:
    """Statistics of one trait (default: the first by name) with columns under their usual names; N is null where the table has none."""
    traits = parquet_traits(df)
    trait = trait or (traits[0] if traits else None)
    if trait not in traits:
        raise ValueError(f"no trait {trait} among {traits}")
    found = {name: next((c for c in names if c in df.columns), None) for name, names in ALIASES.items()}
    if lacking := [n for n, c in found.items() if c is None and n != "N"]:
        raise ValueError(f"no column for {lacking}")
    z = F.try_divide(F.col(f"{trait}_BETA"), F.col(f"{trait}_SE"))
    out = df.select(*[(F.col(c) if c else F.lit(None).cast("double")).alias(n) for n, c in found.items()], z.alias("Z")).where(is_finite(F.col("Z")))
    if maximum_missingness < 1:
        most = out.agg(F.max("N").alias("_most"))
        out = out.join(F.broadcast(most), F.col("N") >= (1 - maximum_missingness) * F.col("_most")).drop("_most")
    return out


def sumstats_of(df: DataFrame, traits: list[str] | None = None) -> DataFrame:
    """Long summary statistics of traits: Z = BETA / SE, finite rows only."""
    traits = traits or parquet_traits(df)
    one = lambda t: F.struct(F.lit(t).alias("trait"), F.try_divide(F.col(f"{t}_BETA"), F.col(f"{t}_SE")).alias("Z"))
    keep: list[Column | str] = [c for c in df.columns if not c.endswith(("_BETA", "_SE"))]
    return df.select(*keep, F.explode(F.array(*[one(t) for t in traits])).alias("x")).select(*keep, "x.*").where(is_finite(F.col("Z")))
