"""CSV sources and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspark.sources import schemas


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers and without an index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a missing file when called, and on a header that differs when read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def load_timeseries(spark: SparkSession, root: str, system_id: str) -> DataFrame:
    return read_csv(spark, f"{root}/timeseries/{system_id}.csv", schemas.GENERATED)


def load_labels(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    df = read_csv(spark, f"{root}/labels.csv", schemas.LABELS)
    return df if source is None else df.where(df["source"] == source)


def load_dataset(series: DataFrame, labels: DataFrame, on: str = "system_id", source: str | None = None) -> DataFrame:
    """Series with their labels, where there are any."""
    if source is not None:
        labels = labels.where(labels["source"] == source)
    return series.join(labels, on, "left")
