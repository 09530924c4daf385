"""Orders over whole tables without a task that sees them all: range partitions, and one row a partition carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.operators.lineage import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions that stay as they are: kept by a checkpoint, with their number. How many is stated, or Spark would merge small rows into one task, whatever their work."""
    return cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its row number, from 0, in the order of some columns."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.row_number().over(within) - 1).cast("long")).drop("_part", "_start")


def last_before(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null at or before each row, in the order of some columns; null without one."""
    ranged = _ranged(df.withColumn("_value", value), order)
    own = ranged.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_own"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = own.select("_part", F.last("_own", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = ranged.join(F.broadcast(carried), "_part").repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")
    return dealt.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(upto), F.col("_carried"))).drop("_part", "_value", "_carried")
