"""Score store as a folder of Parquet tables, and text sinks.

<store>/rows            row_id, keys, jackknife_block, extra columns: written once
<store>/traits/trait=t  row_id, gradient, hessian and extra values: one row a row of the store
<store>/groups          group, traits: small, written anew as a whole
<store>/surrogates      block_id, i, surrogate (-1: none)
"""

from __future__ import annotations

import csv
import fnmatch
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions.scalars import log10_two_sided_p
from blockweave.operators.joins import gene_set_annotations, gene_set_variants, match_annotations, nearest_genes
from blockweave.operators.statistics import meta_analysis, score_test
from blockweave.operators.workflows import RemlFit, convergence_results, reml_results


def write_edgelist(matrix: DataFrame, path: str, folders: bool = False) -> None:
    """Upper triangle, zero-based, six digits: i, j, value, and block_id where a matrix has one.

    The rows of a block lie together in one file, which holds many blocks: files are as many as the data needs, not as blocks are.
    With ``folders`` a block gets a folder of its own with one file; each costs a file's creation, so that is for some hundreds of blocks.
    """
    upper = matrix.where("i <= j").withColumn("value", F.bround("value", 6))
    if "block_id" not in matrix.columns:
        upper.select("i", "j", "value").write.csv(path)
        return
    rows = upper.select("i", "j", "value", "block_id").repartition("block_id")
    if folders:
        rows.write.partitionBy("block_id").csv(path)
    else:
        rows.sortWithinPartitions("block_id", "i", "j").write.csv(path)


# ---- files of a store


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def traits_of(spark: SparkSession, store: str) -> list[str]:
    """Names of a store's traits, from its folders."""
    fs, p = _fs(spark, f"{store}/traits")
    return sorted(s.getPath().getName().removeprefix("trait=") for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def write_rows(store: str, rows: DataFrame) -> None:
    """The rows that all traits of a store share: row_id, keys, jackknife_block."""
    if lacking := {"row_id", "jackknife_block"} - set(rows.columns):
        raise ValueError(f"rows of a store need {sorted(lacking)}")
    rows.write.mode("errorifexists").parquet(f"{store}/rows")


def write_trait(store: str, trait: str, rows: DataFrame, compression: str = "snappy") -> None:
    """Add a trait (row_id, gradient, ...); one that exists is an error, and so is one without a value for each row."""
    spark = rows.sparkSession
    if _exists(spark, f"{store}/rows"):
        n, m = spark.read.parquet(f"{store}/rows").count(), rows.select("row_id").distinct().count()
        if n != m or n != rows.count():
            raise ValueError(f"trait {trait} has {m} rows, the store {n}")
    rows.write.mode("errorifexists").option("compression", compression).parquet(f"{store}/traits/trait={trait}")


def read_traits(spark: SparkSession, store: str, *traits: str) -> DataFrame:
    """Traits of a store; only their folders are read."""
    df = spark.read.parquet(f"{store}/traits")
    return df.where(F.col("trait").isin(*traits)) if traits else df


def read_trait(spark: SparkSession, store: str, trait: str) -> DataFrame:
    """The store's rows with the values of one trait."""
    return spark.read.parquet(f"{store}/rows").join(spark.read.parquet(f"{store}/traits/trait={trait}"), "row_id")


def inventory(spark: SparkSession, store: str) -> DataFrame:
    """(table, column, type, length) of everything in a store; lengths from file footers."""
    out = []
    for table in [t for t in ("rows", "groups", "surrogates") if _exists(spark, f"{store}/{t}")] + [f"traits/trait={t}" for t in traits_of(spark, store)]:
        df = spark.read.parquet(f"{store}/{table}")
        n = df.count()
        out += [(table, name, kind, n) for name, kind in df.dtypes]
    return spark.createDataFrame(out, "table string, column string, type string, length long")


# ---- groups of traits


def read_groups(spark: SparkSession, store: str) -> dict[str, list[str]]:
    """Groups of traits; as many as a user has named."""
    return {r.group: list(r.traits) for r in spark.read.parquet(f"{store}/groups").collect()} if _exists(spark, f"{store}/groups") else {}


def write_groups(spark: SparkSession, store: str, groups: dict[str, list[str]]) -> None:
    spark.createDataFrame(sorted(groups.items()), "group string, traits array<string>").coalesce(1).write.mode("overwrite").parquet(f"{store}/groups")


def group_of(groups: dict[str, list[str]], name: str, pattern: str, traits: list[str]) -> dict[str, list[str]]:
    """Groups with one of the traits that a glob matches: two at least, and no trait's name."""
    found = sorted(t for t in traits if fnmatch.fnmatchcase(t, pattern))
    if len(found) < 2 or name in traits:
        raise ValueError(f"group {name}: {len(found)} traits, or the name of a trait")
    return groups | {name: found}


def add_group(spark: SparkSession, store: str, name: str, pattern: str) -> None:
    write_groups(spark, store, group_of(read_groups(spark, store), name, pattern, traits_of(spark, store)))


def remove_groups(spark: SparkSession, store: str, pattern: str) -> list[str]:
    groups = read_groups(spark, store)
    gone = sorted(g for g in groups if fnmatch.fnmatchcase(g, pattern))
    write_groups(spark, store, {g: t for g, t in groups.items() if g not in gone})
    return gone


def rename_group(spark: SparkSession, store: str, old: str, new: str) -> None:
    groups = read_groups(spark, store)
    if old not in groups or new in groups or new in traits_of(spark, store):
        raise ValueError(f"group {old} isn't there, or {new} is taken")
    write_groups(spark, store, {new if g == old else g: t for g, t in groups.items()})


def drop_traits(groups: dict[str, list[str]], gone: list[str]) -> dict[str, list[str]]:
    """Groups after traits are removed; those with fewer than two left go."""
    left = {g: [t for t in ts if t not in gone] for g, ts in groups.items()}
    return {g: ts for g, ts in left.items() if len(ts) >= 2}


def remove_traits(spark: SparkSession, store: str, pattern: str) -> list[str]:
    """Delete the traits that a glob matches, also from groups."""
    gone = [t for t in traits_of(spark, store) if fnmatch.fnmatchcase(t, pattern)]
    groups = drop_traits(read_groups(spark, store), gone)
    for t in gone:
        fs, p = _fs(spark, f"{store}/traits/trait={t}")
        fs.delete(p, True)
    write_groups(spark, store, groups)
    return gone


def rename_trait(spark: SparkSession, store: str, old: str, new: str) -> None:
    groups = read_groups(spark, store)
    if old not in traits_of(spark, store) or new in traits_of(spark, store) or new in groups:
        raise ValueError(f"trait {old} isn't there, or {new} is taken")
    fs, p = _fs(spark, f"{store}/traits/trait={old}")
    fs.rename(p, _fs(spark, f"{store}/traits/trait={new}")[1])
    write_groups(spark, store, {g: [new if t == old else t for t in ts] for g, ts in groups.items()})


def remove_entries(spark: SparkSession, store: str, pattern: str) -> list[str]:
    """A group of that very name, else a trait of that name, else all groups and traits that the glob matches."""
    if pattern in read_groups(spark, store):
        return remove_groups(spark, store, pattern)
    if pattern in traits_of(spark, store):
        return remove_traits(spark, store, pattern)
    found = remove_groups(spark, store, pattern) + remove_traits(spark, store, pattern)
    if not found:
        raise ValueError(f"nothing matches {pattern}")
    return found


def rename_entry(spark: SparkSession, store: str, old: str, new: str) -> None:
    (rename_group if old in read_groups(spark, store) else rename_trait)(spark, store, old, new)


# ---- surrogate maps


def write_surrogates(surrogates: DataFrame, store: str) -> None:
    surrogates.select("block_id", "i", F.coalesce("surrogate", F.lit(-1)).cast("int").alias("surrogate")).write.mode("errorifexists").parquet(f"{store}/surrogates")


def read_surrogates(spark: SparkSession, store: str, block: str | None = None, base: int = 0) -> DataFrame:
    """(block_id, i, surrogate) from zero; negative numbers are none. ``base`` 1: the stored numbers count from one."""
    df = spark.read.parquet(f"{store}/surrogates")
    at = F.col("surrogate") - base
    return (df.where(F.col("block_id") == block) if block else df).withColumn("surrogate", F.when(at >= 0, at))


# ---- score tests over a store


def expand_traits(names: list[str], groups: dict[str, list[str]], traits: list[str]) -> list[str]:
    """Traits named, with those of named groups, each once in order of naming."""
    out: dict[str, None] = {}
    for n in names:
        if n not in groups and n not in traits:
            raise ValueError(f"no trait or group {n}")
        out |= dict.fromkeys(groups.get(n, [n]))
    return list(out)


def store_scores(spark: SparkSession, store: str, traits: list[str], annotations: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """Rows for score tests: store (the trait), row_nr, jackknife_block, gradient, annotations."""
    rows = spark.read.parquet(f"{store}/rows")
    values = read_traits(spark, store, *traits).select("row_id", F.col("trait").alias("store"), "gradient")
    return match_annotations(rows, annotations.select(*[c for c in annotations.columns if c in (by, "RSID", "gene_id", "gene_name", "SNP", *names)]), by).join(values, "row_id").select("store", F.col("row_id").alias("row_nr"), "jackknife_block", "gradient", *[F.col(n).cast("double").alias(n) for n in names])


def score_test_store(spark: SparkSession, store: str, traits: list[str], annotations: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """Score tests of traits (or of all traits of groups) of a store, one pass for all."""
    wanted = expand_traits(traits, read_groups(spark, store), traits_of(spark, store))
    return score_test(store_scores(spark, store, wanted, annotations, names, by), names)


def meta_test_store(spark: SparkSession, store: str, traits: list[str], annotations: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """Meta-analysis of some traits of a store."""
    wanted = expand_traits(traits, read_groups(spark, store), traits_of(spark, store))
    return meta_analysis(store_scores(spark, store, wanted, annotations, names, by), names)


def gene_set_values(rows: DataFrame, genes: DataFrame, sets: DataFrame, weights: list[float]) -> DataFrame:
    """Store rows of variants with a column for each gene set: the variant's weight in it (0 outside)."""
    near = nearest_genes(rows.withColumnRenamed("row_id", "row_nr"), genes, weights)
    inside = gene_set_variants(near, gene_set_annotations(genes, sets))
    wide = inside.groupBy("row_nr").pivot("set_name").agg(F.sum("weight"))
    names = [c for c in wide.columns if c != "row_nr"]
    return rows.join(wide.withColumnRenamed("row_nr", "row_id"), "row_id", "left").fillna(0.0, subset=names)


def results_table(spark: SparkSession, store: str, names: list[str], annotations: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """One row an annotation: <trait>_Z of each trait, then <group>_Z of each group's meta-analysis."""
    groups = read_groups(spark, store)
    traits = [n for n in names if n not in groups]
    long = score_test_store(spark, store, traits, annotations, columns, by).select("annotation", F.col("store").alias("of"), "z") if traits else None
    for g in [n for n in names if n in groups]:
        part = meta_test_store(spark, store, groups[g], annotations, columns, by).select("annotation", F.lit(g).alias("of"), "z")
        long = part if long is None else long.union(part)
    return long.groupBy("annotation").pivot("of", names).agg(F.max("z")).withColumnsRenamed({n: f"{n}_Z" for n in names})


def gene_score_rows(rows: DataFrame, values: DataFrame, genes: DataFrame, weights: list[float], columns: list[str]) -> DataFrame:
    """Scores of variants carried to genes: gene_id and the weighted sums of numeric columns; others are left out."""
    numeric = [c for c, t in values.dtypes if c in columns and t in ("double", "float", "int", "bigint")]
    near = nearest_genes(rows.join(values, "row_id"), genes, weights)
    return near.groupBy("gene_id").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in numeric])


# ---- results as CSV, written by the driver: a few rows a fit


def _read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that Spark knows; None if it is not there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_reml_results(spark: SparkSession, path: str, fit: RemlFit, layout: str = "tall", name: str = "trait", metric: str = "parameters", append: bool = False, overwrite: bool = False) -> None:
    """tall, wide or convergence (two tables with a blank line between), on any file system that Spark knows.

    Only wide tables can be appended to, under the same header; the file, a line a trait, is then written anew.
    """
    if append and (overwrite or layout != "wide"):
        raise ValueError("only a wide table that is not overwritten can be appended to")
    old = _read_text(spark, path)
    if old is not None and not (append or overwrite):
        raise FileExistsError(path)
    parts = convergence_results(spark, fit) if layout == "convergence" else (reml_results(spark, fit, layout, name, metric),)
    header_is_there = append and old is not None
    if header_is_there and old.split("\n", 1)[0].split(",") != parts[0].columns:
        raise ValueError(f"{path} has another header")
    text = io.StringIO()
    for k, df in enumerate(parts):
        if k:
            text.write("\n")
        lines = csv.writer(text, lineterminator="\n")
        if not header_is_there:
            lines.writerow(df.columns)
        lines.writerows([["NA" if v is None or v != v else v for v in r] for r in df.collect()])
    _write_text(spark, path, (old if header_is_there else "") + text.getvalue())


def write_reml_outputs(spark: SparkSession, prefix: str, fits: dict[str, RemlFit], layout: str = "wide") -> None:
    """<prefix>.convergence.csv of the last fit anew; tall: <prefix>.<trait>.tall.csv, wide: a row a trait in one file a metric."""
    for name, fit in fits.items():
        write_reml_results(spark, f"{prefix}.convergence.csv", fit, "convergence", overwrite=True)
        if layout == "tall":
            write_reml_results(spark, f"{prefix}.{name}.tall.csv", fit, "tall", overwrite=True)
            continue
        for metric in ("parameters", "heritability", "enrichment"):
            write_reml_results(spark, f"{prefix}.{metric}.csv", fit, "wide", name, metric, append=True)


def write_sumstats(rows: DataFrame, path: str, layout: str) -> None:
    """Simulated statistics (SNP, CHR, POS, REF, ALT, Z, N, AF) as tab-separated tables: ldgm, prscs, ldsc or ldpred. SNP NA is left out."""
    per_sd = F.try_divide(F.col("Z"), F.sqrt("N"))
    spread = F.sqrt(2 * F.col("AF") * (1 - F.col("AF")))
    beta, se = F.try_divide(per_sd, spread), F.try_divide(F.lit(1.0), F.sqrt("N") * spread)
    p = F.pow(F.lit(10.0), F.col("log10_p"))
    tables = {
        "ldgm": ["SNP", "CHR", "POS", "REF", "ALT", "Z", "N"],
        "prscs": ["SNP", F.col("ALT").alias("A1"), F.col("REF").alias("A2"), beta.alias("BETA"), p.alias("P")],
        "ldsc": ["SNP", F.col("ALT").alias("A1"), F.col("REF").alias("A2"), "N", "Z"],
        "ldpred": ["CHR", "POS", F.col("SNP").alias("SNP_ID"), "REF", "ALT", F.col("AF").alias("REF_FRQ"), p.alias("PVAL"), beta.alias("BETA"), se.alias("SE"), "N"],
    }
    from blockweave.functions.scalars import log10_two_sided_p

    rows.where("SNP <> 'NA'").withColumn("log10_p", log10_two_sided_p("Z")).select(*tables[layout]).write.csv(path, sep="\t", header=True)
