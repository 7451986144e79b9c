"""Detection on streams with thresholds fixed beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_stream(distances: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A stream (or table) of unit rows (container_id, timestamp_et, unit, score) with threshold and anomaly_flag, by a join with a table of thresholds; a container without a threshold isn't flagged."""
    x = distances.join(thresholds.select("container_id", "threshold"), "container_id", "left")
    return x.withColumn("anomaly_flag", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))


def day_maxima(scored: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream's greatest score of each container and day; a day is final when the watermark has passed it. timestamp_et must be a zoned timestamp here, as watermarks need one."""
    return scored.withWatermark("timestamp_et", delay).groupBy("container_id", F.window("timestamp_et", "1 day")).agg(F.max("score").alias("anomaly_score"))
