"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions that run in Python workers travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["shelfmark"])


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session (spark.checkpoint.dir). Where none is set a session in one process, as in tests, gets a
    temporary one; on a cluster that is an error, as executors share no local folder."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
            atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and return it read from reliable checkpoint files; survives the loss of any executor.

    A checkpointed plan keeps the size estimate of what it replaced. Over rounds of joins that estimate multiplies until the
    planner chokes on its digits, so the rows are wrapped anew, without an estimate; adaptive execution measures them anyway.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of rounds that are over: it does so when the driver's JVM collects its
    garbage, which a driver with little to do may not do for many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """``cut``, then as many partitions as the counted rows need: small results don't drag thousands of empty files along."""
    kept = cut(df)
    return kept.coalesce(max(2, -(-kept.count() // rows_each)))
