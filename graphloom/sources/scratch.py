"""The folder that driver and executors share, and checkpoints in it that cut iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder if driver and tasks are one process, else an error.

    A folder of one machine would lose its files with that machine, so a cluster has to name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            held = sc._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which outlives executors, so later levels don't compute it again."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
