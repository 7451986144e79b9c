"""Strict rolling windows: null until all n values of the window are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _last(window: WindowSpec, n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("a window has at least one row")
    return window.rowsBetween(-(n - 1), 0)


def strict_mean(value: Column, n: int, window: WindowSpec) -> Column:
    w = _last(window, n)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def strict_distance(a: Column, b: Column, n: int, window: WindowSpec) -> Column:
    """Square root of the sum of n squared differences; null if one of them is missing."""
    w, d = _last(window, n), a - b
    return F.when(F.count(d).over(w) == n, F.sqrt(F.sum(d * d).over(w)))


def rolling_euclidean_distance(a: DataFrame, b: DataFrame, n: int, on: str = "ts", value: str = "value", by: list[str] | None = None) -> DataFrame:
    """(by, on, distance) of two series, aligned by a full outer join: one row per position of either series.

    Values that are missing on one side, NaN or infinite break the n windows that they are in. Without ``by`` the series
    is one window, which Spark sorts in one task; name the series' keys in ``by`` where there are many.
    """
    keys = [*(by or []), on]
    clean = lambda df, name: df.select(*keys, finite(F.col(value)).alias(name))
    both = clean(a, "_a").join(clean(b, "_b"), keys, "full_outer")
    return both.select(*keys, strict_distance(F.col("_a"), F.col("_b"), n, Window.partitionBy(*(by or [])).orderBy(on)).alias("distance"))


def finite(value: Column) -> Column:
    """NaN and infinities become null, which no comparison takes for a large number."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
