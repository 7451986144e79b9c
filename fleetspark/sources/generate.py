"""A synthetic fleet: charge cycles, units that follow them, and random anomalies, as one lazy plan.

All draws are functions of (seed, keys), so that rows don't depend on partitioning, order or repeated tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions.draws import between, integer, normal, uniform
from fleetspark.operators.inject import inject_sequence

# Fixed values of the synthetic fleet, here and where a number stands in a formula below: minutes, degrees, shares, exponents.
DAY = 1440
UNITS = 3
BASE_TEMPERATURE, TEMPERATURE_RANGE, NOISE = 50.0, 15.0, 0.01
SHORTEST_CYCLE = 20


def minute_grid(spark: SparkSession, containers: int, days: int, units: int = UNITS, first: int = 0) -> DataFrame:
    """(container_id, unit, pos): a row per container from first on, unit and minute."""
    minutes = days * DAY
    return spark.range(containers * units * minutes).select(
        F.expr(f"{first} + id div {units * minutes}").alias("container_id"), F.expr(f"(id div {minutes}) % {units}").alias("unit"), (F.col("id") % minutes).cast("int").alias("pos")
    )


def cycle_timings(spark: SparkSession, containers: int, days: int, seed: int = 42, per_day: int = 4, first: int = 0) -> DataFrame:
    """(container_id, cycle_idx, cycle_start, cycle_end, peak_intensity, baseline_offset): three to five cycles a day."""
    grid = spark.range(containers * days * 5).selectExpr(f"{first} + id div {5 * days} AS container_id", f"cast((id div 5) % {days} AS int) AS day", "cast(id % 5 AS int) AS slot")
    key = ("container_id", "day")
    cycles = F.greatest(F.lit(3), F.least(F.lit(5), per_day + integer(-1, 2, seed, "cycles", *key)))
    day_start, day_end = F.col("day") * DAY, (F.col("day") + 1) * DAY
    start = (day_start + F.col("slot") * (DAY / cycles) + integer(-20, 20, seed, "jitter", *key, "slot")).cast("int")
    end = F.least(start + integer(180, 3600, seed, "duration", *key, "slot"), day_end)
    rows = grid.select("container_id", (F.col("day") * 5 + F.col("slot")).alias("cycle_idx"), F.when(F.col("slot") < cycles, start).alias("cycle_start"), end.alias("cycle_end"), between(0.85, 1.0, seed, "peak", *key, "slot").alias("peak_intensity"), between(-0.15, 0.15, seed, "baseline", *key).alias("baseline_offset"), day_start.alias("first"), day_end.alias("last"))
    return rows.where(f"cycle_start >= first AND cycle_start < last - {SHORTEST_CYCLE} AND cycle_end - cycle_start >= {SHORTEST_CYCLE}").drop("first", "last")


def charge_pattern(timings: DataFrame, offsets: DataFrame, days: int) -> DataFrame:
    """(container_id, unit, pos, pattern) of the minutes that a cycle covers; all others are 0.

    offsets: container_id, unit, minute_offset. Each cycle rises steeply and declines slowly; where cycles overlap the
    one with the highest cycle_idx counts; the pattern is cut to 0..1.
    """
    total = days * DAY
    c = timings.join(offsets, "container_id").withColumns({"s": F.col("cycle_start") + F.col("minute_offset"), "e": F.least(F.col("cycle_end") + F.col("minute_offset"), F.lit(total))})
    c = c.where(f"s >= 0 AND s < {total} AND e - s >= {SHORTEST_CYCLE}").withColumn("n", F.col("e") - F.col("s"))
    c = c.withColumn("rise", F.greatest(F.lit(5), F.least((F.col("n") * 0.065).cast("int"), F.col("n") - 5)))
    c = c.select("container_id", "unit", "cycle_idx", "s", "n", "rise", "peak_intensity", "baseline_offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    rise = F.pow(F.col("j") / (F.col("rise") - 1), F.lit(0.2))
    # the last minute is 0 exactly; rounding must not go below
    decline = F.pow(F.greatest(F.lit(0.0), 1 - (F.col("j") - F.col("rise")) / (F.col("n") - F.col("rise") - 1)), F.lit(3.5))
    value = F.when(F.col("j") < F.col("rise"), rise).otherwise(decline) * F.col("peak_intensity") + F.col("baseline_offset")
    last = c.select("container_id", "unit", (F.col("s") + F.col("j")).alias("pos"), "cycle_idx", value.alias("v")).groupBy("container_id", "unit", "pos").agg(F.max_by("v", "cycle_idx").alias("v"))
    return last.select("container_id", "unit", "pos", F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0)).alias("pattern"))


def normal_units(grid: DataFrame, pattern: DataFrame, unit_offsets: DataFrame, day_offsets: DataFrame, noise: Column | None = None) -> DataFrame:
    """(container_id, unit, pos, TmpRet): base + unit offset + range * pattern + the day's offset + noise.

    unit_offsets: container_id, unit, temperature_offset; day_offsets: container_id, day, daily_offset.
    """
    x = grid.join(pattern, ["container_id", "unit", "pos"], "left").join(unit_offsets, ["container_id", "unit"])
    x = x.withColumn("day", F.expr(f"pos div {DAY}")).join(day_offsets, ["container_id", "day"])
    value = BASE_TEMPERATURE + F.col("temperature_offset") + TEMPERATURE_RANGE * F.coalesce("pattern", F.lit(0.0)) + F.col("daily_offset")
    return x.select("container_id", "unit", "pos", (value if noise is None else value + noise).alias("TmpRet"))


def random_anomalies(spark: SparkSession, containers: int, days: int, probability: float = 0.2, seed: int = 42, first: int = 0) -> DataFrame:
    """One anomaly, as rows of schemas.ANOMALIES, in each container with that probability."""
    u = lambda tag: uniform(seed, tag, "container_id")
    pick = lambda tag, *values: F.element_at(F.array(*map(F.lit, values)), integer(1, len(values) + 1, seed, tag, "container_id"))
    kind = pick("type", "lag", "frequency", "amplitude")
    return spark.range(first, first + containers).withColumnRenamed("id", "container_id").where(u("has") < probability).select(
        "container_id", F.lit(0).alias("seq"), integer(0, 3, seed, "unit", "container_id").cast("long").alias("unit"), kind.alias("type"),
        integer(1, max(1, days - 2) + 1, seed, "day", "container_id").alias("start_day"), integer(0, 24, seed, "hour", "container_id").alias("start_hour"), pick("hours", 48, 72).alias("duration_hours"),
        F.when(kind == "lag", pick("lag", 60, 120, 180)).alias("lag_minutes"),
        F.when(kind == "amplitude", between(0.2, 0.4, seed, "scale", "container_id")).alias("scale_factor"),
        F.when(kind == "frequency", pick("frequency", 0.2, 0.4, 1.2, 2.0)).alias("frequency_multiplier"),
    )


def generate_fleet(spark: SparkSession, containers: int, start_time: str, days: int, anomaly_probability: float = 0.2, anomalies: DataFrame | None = None, clean: Sequence[int] = (), seed: int = 42, first: int = 0) -> DataFrame:
    """Rows of schemas.GENERATED for containers first to first + n - 1, three units each, a row a minute.

    anomalies: explicit rows of schemas.ANOMALIES, clean: containers without any. Every other container gets a random
    anomaly with the probability. A container's rows depend on its id, the days and the seed alone.
    """
    key = ("container_id", "unit")
    offsets = minute_grid(spark, containers, 1, first=first).where("pos = 0").select(*key, F.when(F.col("unit") == 0, 0).otherwise(integer(-10, 10, seed, "minutes", *key)).alias("minute_offset"), between(-2.0, 2.0, seed, "temperature", *key).alias("temperature_offset"))
    day_offsets = spark.range(containers * days).select(F.expr(f"{first} + id div {days}").alias("container_id"), (F.col("id") % days).alias("day")).withColumn("daily_offset", between(-3.0, 3.0, seed, "daily", "container_id", "day"))
    pattern = charge_pattern(cycle_timings(spark, containers, days, seed, first=first), offsets, days)
    units = normal_units(minute_grid(spark, containers, days, first=first), pattern, offsets, day_offsets, normal(NOISE, seed, "noise", "container_id", "unit", "pos"))
    drawn = random_anomalies(spark, containers, days, anomaly_probability, seed, first)
    if clean:
        drawn = drawn.where(~F.col("container_id").isin(*clean))
    if anomalies is not None:
        drawn = drawn.join(anomalies.select("container_id").distinct(), "container_id", "left_anti").unionByName(anomalies)
    rows = inject_sequence(units.withColumns({"anomaly": F.lit(False), "anomaly_type": F.lit("normal")}), drawn)
    ts = F.to_timestamp_ntz(F.lit(start_time)) + F.make_dt_interval(mins=F.col("pos"))
    return rows.select(ts.alias("timestamp_et"), "unit", "TmpRet", "anomaly", "anomaly_type", "container_id")


def generate_container(spark: SparkSession, container_id: int, start_time: str, days: int, anomalies: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """One container of a fleet, with the explicit anomalies only, in the order of timestamp_et and unit."""
    own = None if anomalies is None else anomalies.where(F.col("container_id") == container_id)
    return generate_fleet(spark, 1, start_time, days, 0.0, own, seed=seed, first=container_id).orderBy("timestamp_et", "unit")
