"""A corpus pipeline of the training-data operators; counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the cluster's shared folder and read again as the next stage's docs. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars).

Cases: null and empty texts pass all stages and are packed as the end token alone; null ids are never
dropped as copies; rows of one id and text count as one document and stay or go together; other
columns than the five are left out; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import decontamination, near_duplicates, packing, pii, toxicity
from blockweave.llm.common import documents, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels that may be learned from (crc32 remainder not 1)."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.8) the smallest id stays."""
    return near_duplicates.keep_representatives(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_contaminated(docs, decontamination.benchmark_table(spark, sf_dir))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become format-preserving pseudonyms."""
    return pii.pseudonymise_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 for training."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("pii", pseudonymise), ("packing", pack)]

#: Stages decode lattices and fit models, which SQL can't express; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage has read is deleted once it has written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
