"""Where rows are written down between steps: a folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share.

    It is the one that the cluster names in spark.checkpoint.dir; only where that is unset and the
    master is local (tests, one machine) a temporary folder stands in.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return str(context._jsc.sc().getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder, without what was estimated of them.

    A checkpoint keeps the estimated size and the constraints of the plan that it stands for. A join's
    estimate is the product of its sides', so that one that a loop joins with itself doubles its
    digits every round and soon fills the driver.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()
    rows = done._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
