"""Summary statistics as a stream: the block join is stateless, so a stream joins the static catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockweave.operators.joins import partition_variants


def stream_blocks(spark: SparkSession, folder: str, schema: str, blocks: DataFrame) -> DataFrame:
    """Variants of new files in a folder with their blocks, as a streaming DataFrame."""
    return partition_variants(spark.readStream.schema(schema).parquet(folder), blocks)
