"""Sensor-shaped views of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four containers of three units, a row a minute without gaps, series of unequal length."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("container_id"), (F.col("event_id") % 3).alias("unit"), "ts", "event_id", F.col("value").alias("TmpRet"))
    minute = F.row_number().over(Window.partitionBy("container_id", "unit").orderBy("ts", "event_id")) - 1
    return e.select("container_id", (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=minute)).alias("timestamp_et"), "unit", "TmpRet")


def sensor_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys, means of six hours, with cells of unit 2 left out."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("container_id"), (F.col("event_id") % 3).alias("unit"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 21600").alias("bucket"), "value")
    cells = e.groupBy("container_id", "unit", "bucket").agg(F.avg("value").alias("TmpRet")).where("NOT (unit = 2 AND bucket % 20 = 0)")
    return cells.select("container_id", (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(hours=(F.col("bucket") * 6).cast("int"))).alias("timestamp_et"), "unit", "TmpRet")
