"""Genetics-shaped views over the driver's star schema, as expressions that both engines read alike.

Numbers are multiples of 1/8 or whole, so sums are exact in any order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockweave.operators.lineage import shared_folder

# name -> (table, expressions, filter)
VIEWS: dict[str, tuple[str, list[str], str]] = {
    "variants": ("part", [
        "CAST(p_partkey AS BIGINT) AS row_nr", "concat('rs', CAST(p_partkey AS VARCHAR(20))) AS SNP", "CAST(p_partkey % 5 + 1 AS INT) AS CHR", "CAST(p_partkey * 10 AS BIGINT) AS POS",
        "CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS REF", "CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'T' ELSE 'A' END AS ALT",
        "CAST((p_partkey * 37) % 97 - 48 AS DOUBLE) / 8 AS Z", "CAST(1000 + p_size AS DOUBLE) AS N"], "true"),
    "blocks": ("part", [
        "DISTINCT CAST(p_partkey % 5 + 1 AS INT) AS chrom", "CAST(floor(CAST(p_partkey AS DOUBLE) / 500) AS BIGINT) * 5000 AS chromStart", "CAST(floor(CAST(p_partkey AS DOUBLE) / 500) AS BIGINT) * 5000 + 5000 AS chromEnd",
        "concat('b', CAST(p_partkey % 5 + 1 AS VARCHAR(20)), '_', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 500) AS BIGINT) AS VARCHAR(20))) AS block_id"], "true"),
    "info": ("part", [
        "concat('b', CAST(p_partkey % 5 + 1 AS VARCHAR(20)), '_', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 500) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey AS BIGINT) AS row_nr",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('rs', CAST(p_partkey AS VARCHAR(20))) END AS site_ids", "CAST(p_partkey * 10 AS BIGINT) AS position", "CAST(floor(CAST(p_partkey % 500 AS DOUBLE) / 2) AS INT) AS index",
        "CASE WHEN p_partkey % 11 = 0 THEN 'X' WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'T' ELSE 'A' END ELSE CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END END AS anc_alleles",
        "CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'c' WHEN 2 THEN 'g' ELSE 't' END ELSE CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'T' ELSE 'A' END END AS deriv_alleles"], "true"),
    "ranges": ("orders", ["CAST(o_orderkey % 5 + 1 AS INT) AS chrom", "CAST((o_orderkey * 7) % 20000 AS BIGINT) AS range_start", "CAST((o_orderkey * 7) % 20000 + 1 + o_orderkey % 40 AS BIGINT) AS range_end"], "true"),
    "genes": ("supplier", ["CAST(s_suppkey AS BIGINT) AS gene_row", "concat('ENSG', CAST(s_suppkey AS VARCHAR(20))) AS gene_id", "s_name AS gene_name", "CAST(s_suppkey % 5 + 1 AS INT) AS CHR", "CAST(s_suppkey * 197 % 20000 AS BIGINT) AS POS", "CAST(s_nationkey AS INT) AS nation"], "true"),
    "annot": ("part", ["CAST(p_partkey AS BIGINT) AS row_nr", "concat(CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE 'rs' END, CAST(p_partkey AS VARCHAR(20))) AS SNP", "CAST(1 AS DOUBLE) AS base", "CAST(p_partkey % 2 AS DOUBLE) AS coding", "CAST(p_size AS DOUBLE) / 8 AS cont"], "true"),
    "score": ("part", ["CAST(p_partkey % 2 AS INT) AS store", "CAST(p_partkey AS BIGINT) AS row_nr", "CAST(floor(CAST(p_partkey AS DOUBLE) / 100) % 7 AS INT) AS jackknife_block", "CAST((p_partkey * 31) % 17 - 8 AS DOUBLE) / 8 AS gradient", "CAST(1 AS DOUBLE) AS base", "CAST(p_partkey % 3 AS DOUBLE) AS cont"], "true"),
    "entries": ("part", [
        "concat('b', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 50) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey % 50 AS INT) AS i", "CAST(least(p_partkey % 50 + 1 + p_size % 3, 49) AS INT) AS j", "CAST(p_size % 5 - 2 AS DOUBLE) / 8 AS value"], "true"),
    "pair_stats": ("part", ["CAST(p_partkey AS BIGINT) AS row_nr", "concat('rs', CAST(p_partkey AS VARCHAR(20))) AS SNP", "CAST(1 AS INT) AS CHR", "CAST(p_partkey * 10 AS BIGINT) AS POS", "'A' AS REF", "'C' AS ALT", "CAST((p_partkey * 37) % 97 - 48 AS DOUBLE) / 8 AS Z", "CAST(1024 AS DOUBLE) AS N", "CAST(p_size % 9 + 1 AS DOUBLE) / 16 AS AF"], "true"),
    "pair_info": ("part", ["concat('p', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey AS BIGINT) AS row_nr", "CAST(p_partkey % 2 AS INT) AS index", "CASE WHEN p_partkey % 13 = 0 THEN 'none' ELSE concat('rs', CAST(p_partkey AS VARCHAR(20))) END AS site_ids", "CAST(p_partkey * 10 AS BIGINT) AS position", "CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE 'A' END AS anc_alleles", "CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'C' END AS deriv_alleles", "CAST(p_size % 7 + 1 AS DOUBLE) / 16 AS af"], "true"),
    "pair_blocks": ("part", ["DISTINCT concat('p', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(1 AS INT) AS chrom", "CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) * 20 AS chromStart", "CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) * 20 + 20 AS chromEnd"], "true"),
    "pair_diagonal": ("part", ["concat('p', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey % 2 AS INT) AS i", "CAST(p_partkey % 2 AS INT) AS j", "CAST(2 + p_size % 4 AS DOUBLE) AS value"], "true"),
    "pair_corner": ("part", ["concat('p', CAST(CAST(floor(CAST(p_partkey AS DOUBLE) / 2) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(0 AS INT) AS i", "CAST(1 AS INT) AS j", "CAST(p_size % 5 - 2 AS DOUBLE) / 4 AS value"], "p_partkey % 2 = 0"),
    # blocks of 1, 3, 5, ... nodes: block b has the numbers b * b to (b + 1) * (b + 1) - 1
    "tri_nodes": ("part", [
        "concat('t', CAST(CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey - CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) * CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS INT) AS i",
        "CAST(p_partkey AS BIGINT) AS row_nr", "CAST((p_partkey * 37) % 97 - 48 AS DOUBLE) / 8 AS z", "CAST(4 + p_size % 3 AS DOUBLE) AS d"], "true"),
    "tri_near": ("part", [
        "concat('t', CAST(CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey - CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) * CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS INT) AS i",
        "CAST(p_partkey - CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) * CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) + 1 + p_size % 3 AS INT) AS j", "CAST(p_size % 5 - 2 AS DOUBLE) / 16 AS value"], "true"),
    "tri_far": ("part", [
        "concat('t', CAST(CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS VARCHAR(20))) AS block_id", "CAST(p_partkey - CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) * CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) AS INT) AS i",
        "CAST(p_partkey - CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) * CAST(floor(sqrt(CAST(p_partkey AS DOUBLE))) AS BIGINT) + 7 + p_size % 11 AS INT) AS j", "CAST(p_partkey % 7 - 3 AS DOUBLE) / 32 AS value"], "true"),
    "graph": ("lineitem", ["CAST(l_partkey % 60 AS INT) AS a", "CAST(l_suppkey % 60 AS INT) AS b", "l_quantity / 8 AS weight"], "l_partkey % 60 <> l_suppkey % 60"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where)
    first = exprs[0].removeprefix("DISTINCT ")
    out = df.selectExpr(first, *exprs[1:])
    return out.distinct() if exprs[0].startswith("DISTINCT ") else out


def cte(*names: str) -> str:
    """WITH clauses of views for an oracle."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]} WHERE {VIEWS[n][2]})" for n in names) + " "


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again, where all executors see it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
