"""Contiguous shards of near equal bytes from global prefix sums. DataFrame functions only.

Rows are range partitioned by doc_id; every partition's total is added up over the (few)
partitions, so that a row knows how many bytes lie before it without one task seeing all rows.
A row belongs to the shard in whose stretch of total/n its middle byte lies.

Cases: a null text has size 1 (no bytes, plus 1) and crc32 0; null ids sort first; rows with the
same id are ordered by crc32 and size, equal rows are interchangeable; an empty table gives no
rows; a shard may be empty when one text is larger than a target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import materialised


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The texts are read and measured, then only four narrow columns move: one range shuffle and
    one by partition number. Broadcast: one row a partition, and one a shard.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    ranged = materialised(sized.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(over_parts), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(over_parts), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count(F.lit(1)).over(inside))
        .join(F.broadcast(before), "part")
        .withColumn("start", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast(((2 * start + size) * {int(n_shards)}) div (2 * total) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
