"""Anomalies in series of (container_id, unit, pos, TmpRet, anomaly, anomaly_type); pos counts a series' rows from 0.

Lag and frequency read the series at another place x: x = pos - lag, or the place that a resampled window puts there.
Both are an equi-join at floor(x) and the next row, with linear interpolation between; amplitude is an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetspark.sources.storage import cut_lineage

BASE_TEMPERATURE = 50.0
KINDS = ("lag", "amplitude", "frequency")


def with_position(df: DataFrame, ties: tuple[str, ...] = ("TmpRet",)) -> DataFrame:
    """pos: a row's place in its unit's series, from 0. Rows of one time come in the order of ties."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("container_id", "unit").orderBy("timestamp_et", *ties)) - 1)


def _step(series: DataFrame, anomalies: DataFrame) -> DataFrame:
    """series with at most one anomaly a container: container_id, a_unit, kind, start, minutes, lag, scale, multiplier."""
    own = Window.partitionBy("container_id", "unit")
    x = series.withColumn("_n", F.count("*").over(own)).join(anomalies, "container_id", "left")
    end = F.least(F.col("start") + F.col("minutes"), F.col("_n"))
    hit = F.coalesce((F.col("pos") >= F.col("start")) & (F.col("pos") < end) & ((F.col("kind") == "amplitude") | (F.col("unit") == F.col("a_unit"))), F.lit(False))
    length, k = (end - F.col("start")).cast("int"), (F.col("pos") - F.col("start")).cast("int")
    size = (length / F.col("multiplier")).cast("int")  # of the resampled window
    kk = F.when(size >= length, k).otherwise(F.try_mod(k, size))
    at = F.when(size == 1, F.lit(0.0)).otherwise(F.try_divide(kk * (length - 1), size - 1))
    place = F.when(hit & (F.col("kind") == "lag") & (F.col("start") >= F.col("lag")), (F.col("pos") - F.col("lag")).cast("double"))
    place = place.when(hit & (F.col("kind") == "frequency"), F.col("start") + at)
    x = x.withColumns({"_hit": hit, "_x": place}).withColumn("_floor", F.floor("_x").cast("int"))
    moved = x.where("_x IS NOT NULL").select("container_id", "unit", "pos", "_x", "_floor")
    source = series.select("container_id", "unit", F.col("pos").alias("_floor"), F.col("TmpRet").alias("_here"))
    then = series.select("container_id", "unit", (F.col("pos") - 1).alias("_floor"), F.col("TmpRet").alias("_next"))
    moved = moved.join(source, ["container_id", "unit", "_floor"]).join(then, ["container_id", "unit", "_floor"], "left")
    part = F.col("_x") - F.col("_floor")
    moved = moved.select("container_id", "unit", "pos", F.when(part == 0, F.col("_here")).otherwise(F.col("_here") + part * (F.col("_next") - F.col("_here"))).alias("_new"))
    x = x.drop("_x", "_floor").join(moved, ["container_id", "unit", "pos"], "left")
    value = F.when(F.col("_hit") & (F.col("kind") == "amplitude"), BASE_TEMPERATURE + (F.col("TmpRet") - BASE_TEMPERATURE) * F.col("scale")).otherwise(F.coalesce("_new", "TmpRet"))
    return x.select(*(value.alias(c) if c == "TmpRet" else (F.col("anomaly") | F.col("_hit")).alias(c) if c == "anomaly" else F.when(F.col("_hit"), F.col("kind")).otherwise(F.col(c)).alias(c) if c == "anomaly_type" else F.col(c) for c in series.columns))


def inject_sequence(series: DataFrame, anomalies: DataFrame, strict: bool = False) -> DataFrame:
    """series with the anomalies (rows of schemas.ANOMALIES) of each container, in the order of seq; each reads what the last one left.

    A start past the end does nothing, an end past it is cut. A lag that starts earlier than it reaches back labels its
    rows and leaves their values; an amplitude applies to all units. Unknown types are ignored, or refused if strict.
    A frequency whose resampled window would be empty is refused.
    """
    if strict and (bad := anomalies.where(~F.col("type").isin(*KINDS)).select("type").first()):
        raise ValueError(f"Unknown anomaly type: {bad['type']!r}")
    a = anomalies.where(F.col("type").isin(*KINDS)).select(
        "container_id", "seq", F.col("unit").alias("a_unit"), F.col("type").alias("kind"), (F.coalesce("start_day", F.lit(0)) * 1440 + F.coalesce("start_hour", F.lit(0)) * 60).alias("start"),
        (F.coalesce("duration_hours", F.lit(1)) * 60).alias("minutes"), F.coalesce("lag_minutes", F.lit(30)).alias("lag"), F.coalesce("scale_factor", F.lit(0.3)).alias("scale"), F.coalesce("frequency_multiplier", F.lit(2.0)).alias("multiplier"),
    )
    a = a.withColumn("multiplier", F.when((F.col("kind") == "frequency") & ((F.col("multiplier") <= 0) | (F.col("minutes") / F.col("multiplier") < 1)), F.raise_error(F.lit("the resampled window is empty"))).otherwise(F.col("multiplier")))
    order = Window.partitionBy("container_id").orderBy("seq")
    a = a.withColumn("step", F.row_number().over(order)).drop("seq")
    steps = a.agg(F.max("step")).first()[0] or 0  # the longest list of a container
    for step in range(1, steps + 1):
        series = _step(series, a.where(F.col("step") == step).drop("step"))
        if step < steps:  # a step reads its input three times
            series = cut_lineage(series)
    return series
