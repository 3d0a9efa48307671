"""Lineage cuts for iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master, whose executors share the driver's disk, gets a temporary folder where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="ckpt")


def cut(df: DataFrame, estimate: bool = True) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage, so that lost executors cost a re-read only.

    A checkpoint keeps the planner's estimate of its size, which is a product for each join. Who cuts in a loop has it forgotten
    (``estimate``): a number that has four times the digits after each round fills the driver.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    if estimate:
        return out
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what was computed before the last cuts.

    Its cleaner learns from the driver's garbage collector which shuffles nothing refers to any more, and a driver with
    memory to spare may not collect for a long time; so a long job says when it is between two steps.
    """
    spark._jvm.System.gc()
