"""Where intermediate rows go when a plan would repeat itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session without it gets one of its own, which goes when the driver exits."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="fleetspark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
