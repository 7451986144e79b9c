"""Reports and the data of plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit_day(df: DataFrame) -> DataFrame:
    """df with cont_unit_day: container, unit and date in one key; null if one of them is."""
    return df.withColumn("cont_unit_day", F.concat("container_id", F.lit("_"), "unit", F.lit("_"), F.to_date("timestamp_et")))


def type_distribution(df: DataFrame) -> DataFrame:
    """anomaly_type, unit_days, percentage of all types' unit-days; a unit-day of several types counts for each."""
    n = df.where("anomaly_type IS NOT NULL").groupBy("anomaly_type").agg(F.countDistinct("cont_unit_day").alias("unit_days"))
    return n.withColumn("percentage", F.bround(100.0 * F.col("unit_days") / F.sum("unit_days").over(Window.partitionBy()), 2))  # a row a type


def unit_day_share(df: DataFrame) -> DataFrame:
    """anomaly_type, unit_days, percentage of all unit-days, those without an anomaly included; one that several types touch counts for each."""
    per = df.where("cont_unit_day IS NOT NULL").groupBy("cont_unit_day").agg(F.collect_set(F.when(F.col("anomaly"), F.col("anomaly_type"))).alias("types"))  # a set of types
    n = per.agg(F.count("*").alias("all_days"))
    by_type = per.select(F.explode("types").alias("anomaly_type")).groupBy("anomaly_type").agg(F.count("*").alias("unit_days"))
    return by_type.join(F.broadcast(n)).select("anomaly_type", "unit_days", F.bround(100.0 * F.col("unit_days") / F.col("all_days"), 2).alias("percentage"))  # one row


def type_counts(df: DataFrame) -> DataFrame:
    """anomaly_type, n of the anomalous rows."""
    return df.where("anomaly").groupBy("anomaly_type").agg(F.count("*").alias("n"))


def anomaly_rate(df: DataFrame) -> DataFrame:
    """One row: rows, anomalies, percentage, containers."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.col("anomaly").cast("int")).alias("anomalies"), (F.avg(F.col("anomaly").cast("int")) * 100).alias("percentage"), F.countDistinct("container_id").alias("containers"))


def containers_with(df: DataFrame, anomaly_type: str, n: int, seed: int | None = 42) -> DataFrame:
    """At most n containers that have the type: in the order of a hash, or of their ids without a seed."""
    ids = df.where(F.col("anomaly_type") == anomaly_type).select("container_id").distinct()
    return ids.orderBy("container_id" if seed is None else F.xxhash64("container_id", F.lit(seed)), "container_id").limit(n)


def plot_series(df: DataFrame, anomaly_type: str = "amplitude", n: int = 1, seed: int | None = 42) -> DataFrame:
    """container_id, trace, kind, axis, x, y, and has_anomaly (whether a legend entry for anomalies is due) of n sampled containers.

    Lines: every reading, a trace a unit. Markers: for lag and frequency the anomalous rows, a trace a unit, at y = 1;
    for other types one trace of all rows at 0 or 1. No container of the type: no rows.
    """
    own = df.join(F.broadcast(containers_with(df, anomaly_type, n, seed)), "container_id")  # n rows
    lines = own.select("container_id", F.concat(F.lit("unit "), F.col("unit")).alias("trace"), F.lit("line").alias("kind"), F.lit("y").alias("axis"), F.col("timestamp_et").alias("x"), F.col("TmpRet").alias("y"), "anomaly")
    if anomaly_type in ("lag", "frequency"):
        marks = own.where("anomaly").select("container_id", F.concat(F.lit("anomaly of unit "), F.col("unit")).alias("trace"), F.lit("marker").alias("kind"), F.lit("y2").alias("axis"), F.col("timestamp_et").alias("x"), F.lit(1.0).alias("y"), "anomaly")
    else:
        marks = own.select("container_id", F.lit("anomaly").alias("trace"), F.lit("marker").alias("kind"), F.lit("y2").alias("axis"), F.col("timestamp_et").alias("x"), F.col("anomaly").cast("int").cast("double").alias("y"), "anomaly")
    both = lines.unionByName(marks)
    return both.withColumn("has_anomaly", F.bool_or("anomaly").over(Window.partitionBy("container_id", "trace"))).drop("anomaly")


def title(anomaly_type: str) -> str:
    return f"{anomaly_type.capitalize()} anomalies"


def distances_with_truth(distances: DataFrame, day_labels: DataFrame) -> DataFrame:
    """distances with truth: whether the container's day holds a labelled anomaly (container_id, day)."""
    truth = day_labels.select("container_id", "day").distinct().withColumn("truth", F.lit(True))
    x = distances.withColumn("day", F.to_date("timestamp_et")).join(truth, ["container_id", "day"], "left")
    return x.withColumn("truth", F.coalesce("truth", F.lit(False))).drop("day")


def score_overlay(df: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """container_id, trace, axis, x, y: every reading as a line of its unit, and every score as a line on the second axis; missing scores leave gaps."""
    line = lambda d, name, axis, y: d.select("container_id", F.concat(F.lit(name), F.col("unit")).alias("trace"), F.lit(axis).alias("axis"), F.col("timestamp_et").alias("x"), F.col(y).cast("double").alias("y"))
    return line(df, "unit ", "y", "TmpRet").unionByName(line(scores, "score of unit ", "y2", score))


def flagged_series(df: DataFrame, flags: DataFrame) -> DataFrame:
    """df's container_id, unit, timestamp_et and TmpRet with flagged: whether the detector flagged the unit then; times without a flag count as not flagged."""
    key = ["container_id", "unit", "timestamp_et"]
    hit = flags.where("anomaly_flag").select(*key).distinct().withColumn("flagged", F.lit(True))
    return df.select(*key, "TmpRet").join(hit, key, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def grouped_bars(results: DataFrame, group: str = "method", metrics: tuple[str, ...] = ("auc_pr", "auc_roc")) -> DataFrame:
    """group, metric, value: a bar per group and metric; metrics without a value have no bar."""
    bars = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return results.select(F.col(group).alias("group"), bars.alias("b")).select("group", "b.metric", "b.value").where("value IS NOT NULL")
