"""Detection: smooth each unit, measure how far units of a container drift apart, and flag units that leave both others.

Everything is partitioned by container: dealing the rows out by container_id first gives one exchange for smoothing,
pivot and pair windows together. That is best for many containers. For few and long ones ``chunk_minutes`` deals a
container's time out in chunks, with the same rows as a result; what is used twice is then written once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetspark.functions.chunks import chunk_of, in_chunk, originals, with_overlap
from fleetspark.functions.rolling import finite, strict_distance, strict_mean
from fleetspark.sources.storage import cut_lineage

# Fixed values of the interface, as are the columns' names: units, windows, strategies with their default k.
UNITS = (0, 1, 2)
SMOOTH_WINDOW, DISTANCE_WINDOW = 10, 60
STRATEGIES = {"mad": 3.0, "iqr": 1.5, "mean_std": 3.0}
# Fixed value: makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.4826


def pairs(units=UNITS) -> list[tuple[int, int]]:
    return list(combinations(units, 2))


def ingest(df: DataFrame) -> DataFrame:
    """container_id, timestamp_et, unit, TmpRet of rows whose keys are all there; readings that are no finite number become null."""
    keys = ("container_id", "timestamp_et", "unit")
    return df.select(*keys, finite(F.col("TmpRet")).alias("TmpRet")).dropna(subset=list(keys))


def smoothed(df: DataFrame, window: int = SMOOTH_WINDOW, ties: tuple[str, ...] = ("TmpRet",), chunk_minutes: int | None = None) -> DataFrame:
    """TmpRet_smooth: the mean of a unit's own last rows, null until there are that many and none of them null. Rows of one time come in the order of ties."""
    if chunk_minutes:
        keys, order = ["container_id", "unit"], ["timestamp_et", *ties]
        x = with_overlap(df, keys, order, chunk_of("timestamp_et", chunk_minutes), window - 1)
        return originals(x.withColumn("TmpRet_smooth", strict_mean(F.col("TmpRet"), window, in_chunk(keys, order))))
    return df.withColumn("TmpRet_smooth", strict_mean(F.col("TmpRet"), window, Window.partitionBy("container_id", "unit").orderBy("timestamp_et", *ties)))


def pivoted(df: DataFrame, value: str = "TmpRet_smooth", units=UNITS) -> DataFrame:
    """container_id, timestamp_et and a column u<unit> each: a row per time at which any unit, listed or not, has a value; duplicates are averaged."""
    return df.where(F.col(value).isNotNull()).groupBy("container_id", "timestamp_et").agg(*(F.avg(F.when(F.col("unit") == u, F.col(value))).alias(f"u{u}") for u in units))


def _present(wide: DataFrame, columns: list[str], chunked: bool) -> DataFrame:
    """wide with has_<column>: whether the container has a value in it at any time."""
    if chunked:
        there = wide.groupBy("container_id").agg(*((F.count(c) > 0).alias(f"has_{c}") for c in columns))  # a row a container
        return wide.join(there, "container_id")
    own = Window.partitionBy("container_id")
    return wide.select("*", *((F.count(c).over(own) > 0).alias(f"has_{c}") for c in columns))


def wide_distances(df: DataFrame, smooth_window: int = SMOOTH_WINDOW, dist_window: int = DISTANCE_WINDOW, units=UNITS, chunk_minutes: int | None = None) -> DataFrame:
    """container_id, timestamp_et, and for each pair d<i>_<j> (its rolling distance) and has_<i>_<j> (whether the container has both units)."""
    if chunk_minutes:
        wide = cut_lineage(pivoted(smoothed(ingest(df), smooth_window, chunk_minutes=chunk_minutes), units=units))
        x = with_overlap(wide, ["container_id"], ["timestamp_et"], chunk_of("timestamp_et", chunk_minutes), dist_window - 1)
        by_time = in_chunk(["container_id"], ["timestamp_et"])
    else:
        x = pivoted(smoothed(ingest(df).repartition("container_id"), smooth_window), units=units)
        by_time = Window.partitionBy("container_id").orderBy("timestamp_et")
    x = x.withColumns({f"d{i}_{j}": strict_distance(F.col(f"u{i}"), F.col(f"u{j}"), dist_window, by_time) for i, j in pairs(units)})
    x = _present(originals(x) if chunk_minutes else x, [f"u{u}" for u in units], bool(chunk_minutes))
    return x.select("container_id", "timestamp_et", *(f"d{i}_{j}" for i, j in pairs(units)), *((F.col(f"has_u{i}") & F.col(f"has_u{j}")).alias(f"has_{i}_{j}") for i, j in pairs(units)))


def _long(wide: DataFrame, units=UNITS) -> DataFrame:
    rows = ", ".join(f"'{i}_{j}', d{i}_{j}, has_{i}_{j}" for i, j in pairs(units))
    return wide.selectExpr("container_id", "timestamp_et", f"stack({len(pairs(units))}, {rows}) AS (pair, distance, has)").where("has").drop("has")


def compute_pairwise_distances(df: DataFrame, smooth_window: int = SMOOTH_WINDOW, dist_window: int = DISTANCE_WINDOW, units=UNITS, chunk_minutes: int | None = None) -> DataFrame:
    """container_id, timestamp_et, pair ("0_1"), distance: of each pair of units that the container has, at every time that any unit has a smoothed value."""
    return _long(wide_distances(df, smooth_window, dist_window, units, chunk_minutes), units)


def check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy!r}. Use one of {', '.join(map(repr, STRATEGIES))}.")


def thresholds(distances: DataFrame, strategy: str = "mad", k: float | None = None, chunked: bool = False) -> DataFrame:
    """container_id, threshold, strategy: over all distances of a container, whatever their pair; null for a container without any.

    chunked: medians are aggregated and joined instead of a window, so that a container isn't one task.
    """
    check_strategy(strategy)
    k = STRATEGIES[strategy] if k is None else k
    d = distances.where("container_id IS NOT NULL").select("container_id", F.when(~F.isnan("distance"), F.col("distance")).alias("x"))
    if strategy == "mad":
        d = d.join(d.groupBy("container_id").agg(F.median("x").alias("m")), "container_id") if chunked else d.withColumn("m", F.median("x").over(Window.partitionBy("container_id")))
        limit: Column = F.max("m") + float(k) * F.median(F.abs(F.col("x") - F.col("m"))) * MAD_SCALE
    elif strategy == "iqr":
        q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))
        limit = q[1] + float(k) * (q[1] - q[0])
    else:
        limit = F.avg("x") + float(k) * F.stddev("x")
    return d.groupBy("container_id").agg(limit.alias("threshold")).select("container_id", "threshold", F.lit(strategy).alias("strategy"))


def _flags(wide: DataFrame, limits: DataFrame, strategy: str, units=UNITS) -> DataFrame:
    """wide: d<i>_<j> and has_<i>_<j> of rows that have any distance."""
    name = lambda x, y: f"{min(x, y)}_{max(x, y)}"
    rows = []
    for u in units:
        others = [v for v in units if v != u]
        fields = [F.lit(u).cast("long").alias("unit"), *((F.lit(0.0) if v == u else F.col(f"d{name(u, v)}")).alias(f"dist_{v}") for v in units)]
        over, has = F.lit(True), F.lit(True)
        for v in others:
            over = over & (F.col(f"d{name(u, v)}") > F.col("threshold"))
            has = has & F.col(f"has_{name(u, v)}")
        rows.append(F.struct(*fields, F.coalesce(over, F.lit(False)).alias("anomaly_flag"), has.alias("has")))
    x = wide.join(limits.select("container_id", "threshold"), "container_id").select("timestamp_et", "container_id", F.explode(F.array(*rows)).alias("r"))
    return x.where("r.has").select("timestamp_et", "container_id", "r.unit", *(f"r.dist_{v}" for v in units), "r.anomaly_flag", F.lit(f"euclidean_distance_{strategy}").alias("model"))


def flag_anomalies(distances: DataFrame, strategy: str = "mad", k: float | None = None, units=UNITS) -> tuple[DataFrame, DataFrame]:
    """(unit rows, thresholds) from distances in long form.

    A unit is flagged where its distances to all others exceed its container's threshold. Units of which a pair is
    missing in the container have no rows, nor have times without any distance.
    """
    limits = thresholds(distances, strategy, k)
    d = distances.where("container_id IS NOT NULL AND timestamp_et IS NOT NULL AND pair IS NOT NULL AND distance IS NOT NULL AND NOT isnan(distance)")
    wide = d.groupBy("container_id", "timestamp_et").agg(*(F.avg(F.when(F.col("pair") == f"{i}_{j}", F.col("distance"))).alias(f"d{i}_{j}") for i, j in pairs(units)))
    own = Window.partitionBy("container_id")
    wide = wide.select("*", *((F.count(f"d{i}_{j}").over(own) > 0).alias(f"has_{i}_{j}") for i, j in pairs(units)))
    return _flags(wide, limits, strategy, units), limits


def detect(df: DataFrame, smooth_window: int = SMOOTH_WINDOW, dist_window: int = DISTANCE_WINDOW, strategy: str = "mad", k: float | None = None, units=UNITS, chunk_minutes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """flag_anomalies of compute_pairwise_distances, without the way through the long form."""
    check_strategy(strategy)
    wide = wide_distances(df, smooth_window, dist_window, units, chunk_minutes)
    if chunk_minutes:
        wide = cut_lineage(wide)
    limits = thresholds(_long(wide, units), strategy, k, bool(chunk_minutes))
    distances = [f"d{i}_{j}" for i, j in pairs(units)]
    some = F.lit(False)
    for d in distances:
        some = some | F.col(d).isNotNull()
    wide = _present(wide.where(some).select("container_id", "timestamp_et", *distances), distances, bool(chunk_minutes))
    return _flags(wide.withColumnsRenamed({f"has_{d}": f"has_{d[1:]}" for d in distances}), limits, strategy, units), limits


def unit_scores(flags: DataFrame, units=UNITS) -> DataFrame:
    """flags with score: the least distance to another unit, null if one is missing; score > threshold is the flag."""
    score = None
    for u in units:
        others = [F.col(f"dist_{v}") for v in units if v != u]
        there = others[0].isNotNull()
        for c in others[1:]:
            there = there & c.isNotNull()
        value = F.when(there, F.least(*others) if len(others) > 1 else others[0])
        score = F.when(F.col("unit") == u, value) if score is None else score.when(F.col("unit") == u, value)
    return flags.withColumn("score", score)
