"""Shared helpers of the training-data operators.

Every operator takes a DataFrame of documents, selects the columns it needs by name and
carries nothing else, so extra or clashing columns never matter.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python kernel at once; keeps memory flat when texts are long.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_slices(df: DataFrame, kernel: Callable[[dict[str, list]], dict[str, list] | None], schema: str, arrow: pa.Schema, finish: Callable[[], dict[str, list]] | None = None) -> DataFrame:
    """Run ``kernel`` over slices of each partition, as Python lists by column.

    ``kernel`` returns the columns of ``schema`` or None. ``finish`` (rebuilt per task through
    ``kernel.start()`` when the kernel has state) yields what a partition has gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kernel.start() if hasattr(kernel, "start") else kernel
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = state({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if hasattr(state, "finish"):
            for out in state.finish():
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def id_remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; null ids count as held out (1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; without one, a folder of the warehouse, and on a local master a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_folder()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="blockweave-checkpoints-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_dir(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder, if nothing is set yet."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialised(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """As ``materialised``, for tables of short rows: read again in about one partition per ``rows`` rows, so that few rows don't become many tiny shuffle files. Large tables keep their partitions."""
    out = materialised(df)
    return out.coalesce(parts(out.count(), rows))


def parts(n: int, rows: int = 100_000) -> int:
    """Partitions for ``n`` short rows; never fewer than FEW."""
    return max(FEW, -(-n // rows))


#: Partitions of the smallest tables.
FEW = 4
