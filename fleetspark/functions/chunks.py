"""Rolling windows over long series, in chunks: a chunk also gets the rows before it that its first windows reach back to.

A window that is partitioned by the series' keys alone is one task a series. Here a series is dealt out in chunks of
time, and every chunk's windows see the rows that they need, however many chunks back these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Columns that with_overlap adds.
CHUNK, COPY = "_chunk", "_copy"


def chunk_of(timestamp: str, minutes: int) -> Column:
    """The number of the stretch of so many minutes that a time is in."""
    if minutes < 1:
        raise ValueError("a chunk has at least one minute")
    return F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', {timestamp}) div {minutes}")


def with_overlap(df: DataFrame, keys: list[str], order: list[str], chunk: Column, reach: int) -> DataFrame:
    """df with _chunk and _copy: each row in its own chunk, and as a copy in every later one that starts at most reach rows after it.

    chunk must not fall along the order. Rows without keys are dropped.
    """
    dealt = df.withColumn(CHUNK, chunk)
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)) - 1)
    sizes = dealt.groupBy(*keys, CHUNK).agg(F.count("*").alias("_size"))
    series = Window.partitionBy(*keys).orderBy(CHUNK)  # a row a chunk
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # chunks that have rows: no more than reach of them can start that soon
    later = F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("_before").alias("b"))).over(series.rowsBetween(1, max(1, reach)))
    x = placed.join(starts.select(*keys, CHUNK, "_before", later.alias("_later")), [*keys, CHUNK])
    soon = F.filter("_later", lambda l: l["b"] - (F.col("_before") + F.col("_place")) <= reach)
    to = F.concat(F.array(F.struct(F.col(CHUNK).alias("c"), F.lit(False).alias("copy"))), F.transform(soon, lambda l: F.struct(l["c"].alias("c"), F.lit(True).alias("copy"))))
    x = x.withColumn("_to", F.explode(to))
    return x.select(*df.columns, F.col("_to.c").alias(CHUNK), F.col("_to.copy").alias(COPY))


def in_chunk(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def originals(df: DataFrame) -> DataFrame:
    return df.where(~F.col(COPY)).drop(CHUNK, COPY)
