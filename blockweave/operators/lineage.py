"""Cut points of iterative jobs: checkpoints in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one, a folder of the warehouse, and on a local master a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_folder()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="blockweave-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint: plans of later rounds don't grow, and lost executors cost one round."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
