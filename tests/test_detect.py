"""Properties of the detector, and one test for each trap of its semantics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fleetspark.functions.chunks import chunk_of, in_chunk, with_overlap
from fleetspark.functions.rolling import rolling_euclidean_distance
from fleetspark.operators import detect
from fleetspark.operators.baselines import zscores
from fleetspark.operators.inject import with_position
from fleetspark.sources import schemas

T0 = dt.datetime(2024, 3, 9, 22, 0)
SMOOTH, DISTANCE = 2, 4


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def steps(container, n, unit_values):
    """unit_values: for each unit a function of the minute."""
    return [(container, at(m), u, float(f(m))) for u, f in enumerate(unit_values) for m in range(n)]


@pytest.fixture(scope="module")
def ramp(spark):
    """Container 4: units 0 and 1 rise alike, 1 a constant 2 above; unit 2 leaves by 6 from minute 12 to 19."""
    return spark.createDataFrame(steps(4, 40, [lambda m: m, lambda m: m + 2, lambda m: m + (7 if 12 <= m < 20 else 1)]), schemas.SENSOR).cache()


@pytest.fixture(scope="module")
def pairs(ramp):
    return detect.compute_pairwise_distances(ramp, SMOOTH, DISTANCE).cache()


def series(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "ts long, value double")


def rolled(spark, a, b, n):
    return [r["distance"] for r in rolling_euclidean_distance(series(spark, a), series(spark, b), n).orderBy("ts").collect()]


def test_rolling_distance(spark):
    got = rolled(spark, [3.0, 0.0, 0.0, 5.0, 1.0], [0.0, 4.0, 0.0, -7.0, 1.0], 2)
    assert got == [None, 5.0, 4.0, 12.0, 12.0]
    assert rolled(spark, [2.5] * 4, [2.5] * 4, 3) == [None, None, 0.0, 0.0]


def test_rolling_distance_needs_every_value(spark):
    gap = rolled(spark, [1.0, 2.0, float("nan"), 4.0, 5.0, float("inf"), 7.0, 8.0], [0.0] * 9, 2)  # the ninth has no partner
    assert [x is None for x in gap] == [True, False, True, True, False, True, True, False, True]
    assert rolled(spark, [1.0, 2.0], [0.0, 0.0], 3) == [None, None]


def test_pairs(pairs):
    """Means of two minutes, distances over four of them: sqrt(4) * 2 for 0 and 1, whatever happens to unit 2."""
    got = {(r["pair"], (r["timestamp_et"] - T0).seconds // 60): r["distance"] for r in pairs.collect()}
    assert len(got) == 3 * 39 and min(m for _, m in got) == 1
    assert all(got[p, m] is None for p in ("0_1", "0_2", "1_2") for m in (1, 2, 3))
    assert all(got["0_1", m] == pytest.approx(4) for m in range(4, 40))
    # unit 2's mean is 1, 4 (minute 12), 7 (13 to 19), 4 (20), 1 above unit 0's
    above = {m: 4 if m in (12, 20) else 7 if 13 <= m <= 19 else 1 for m in range(1, 40)}
    for m in range(4, 40):
        assert got["0_2", m] == pytest.approx(math.sqrt(sum(above[k] ** 2 for k in range(m - 3, m + 1))))
        assert got["1_2", m] == pytest.approx(math.sqrt(sum((above[k] - 2) ** 2 for k in range(m - 3, m + 1))))


def test_flags(pairs):
    """Pooled distances are mostly 2 and 4, so that both median and median deviation are known, and unit 2 alone exceeds the limit to both others."""
    flags, limits = detect.flag_anomalies(pairs, "mad", 1)
    row = limits.first()
    assert (row["container_id"], row["strategy"]) == (4, "mad") and row["threshold"] == pytest.approx(4 + 2 * 1.4826)
    rows = {(r["unit"], (r["timestamp_et"] - T0).seconds // 60): r for r in flags.collect()}
    assert len(rows) == 3 * 36
    for (unit, m), r in rows.items():
        own = {v: r[f"dist_{v}"] for v in (0, 1, 2)}
        assert own.pop(unit) == 0 and r["anomaly_flag"] == all(d > row["threshold"] for d in own.values()) and r["model"] == "euclidean_distance_mad"
    assert {u for (u, _), r in rows.items() if r["anomaly_flag"]} == {2} and rows[2, 16]["anomaly_flag"] and not rows[2, 30]["anomaly_flag"]


def test_detect_is_flags_of_pairs(ramp, pairs):
    for strategy in detect.STRATEGIES:
        a, b = detect.detect(ramp, SMOOTH, DISTANCE, strategy)[0], detect.flag_anomalies(pairs, strategy)[0]
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_thresholds_of_each_container(spark):
    """Two units a constant c apart have distances of sqrt(DISTANCE) * c only, so the median is the threshold of k = 0."""
    rows = [r for c, gap in ((7, 1), (8, 3)) for r in steps(c, 12, [lambda m: 0, lambda m, gap=gap: gap])]
    found = detect.thresholds(detect.compute_pairwise_distances(spark.createDataFrame(rows, schemas.SENSOR), SMOOTH, DISTANCE), "mad", 0)
    assert {r["container_id"]: r["threshold"] for r in found.collect()} == {7: 2.0, 8: 6.0}


def test_ties_have_an_order(spark):
    rows = [(0, at(0), 0, 5.0), (0, at(0), 0, 1.0), (0, at(1), 0, 2.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schemas.SENSOR)
        assert sorted((r["TmpRet"], r["TmpRet_smooth"]) for r in detect.smoothed(df, 2).where("TmpRet_smooth IS NOT NULL").collect()) == [(2.0, 3.5), (5.0, 3.0)]
        assert sorted((r["pos"], r["TmpRet"]) for r in with_position(df).collect()) == [(0, 1.0), (1, 5.0), (2, 2.0)]


def test_thresholds(spark):
    d = spark.createDataFrame([(0, T0, "0_1", x) for x in (1.0, 2.0, 4.0, 9.0, None, float("nan"))] + [(0, T0, "other", 5.0), (1, T0, "0_1", None), (None, T0, "0_1", 3.0)], schemas.PAIR_DISTANCE)
    limit = lambda s, k: {r["container_id"]: r["threshold"] for r in detect.thresholds(d, s, k).collect()}
    assert limit("mad", 0) == {0: 4.0, 1: None}  # pooled over all pairs, k = 0 honoured, a container without distances kept
    assert limit("mad", 1)[0] == pytest.approx(4 + 2 * 1.4826)
    assert limit("iqr", 1)[0] == pytest.approx(5 + (5 - 2))


def test_strategy_is_checked_at_once(pairs):
    for call in (lambda: detect.flag_anomalies(pairs, "nope"), lambda: detect.detect(pairs, strategy="nope"), lambda: detect.thresholds(pairs, "nope")):
        with pytest.raises(ValueError, match="Unknown strategy"):
            call()


def test_strict_comparison_and_constant_units(spark):
    rows = [(0, at(m), u, 50.0) for u in range(3) for m in range(20)]
    flags, limits = detect.detect(spark.createDataFrame(rows, schemas.SENSOR), 2, 3)
    assert limits.first()["threshold"] == 0 and flags.count() > 0 and flags.where("anomaly_flag").count() == 0


def test_skeleton(spark):
    """Windows count times at which any unit has a value, smoothing counts a unit's own rows."""
    full = [(0, at(m), u, float(m * u)) for u in range(3) for m in range(12)]
    gone = [r for r in full if not (r[2] == 2 and r[1] == at(6))]  # one unit lacks a time
    d = detect.compute_pairwise_distances(spark.createDataFrame(gone, schemas.SENSOR), 1, 3)
    missing = lambda pair: sorted((r["timestamp_et"] - T0).seconds // 60 for r in d.where(f"pair = '{pair}' AND distance IS NULL").collect())
    assert missing("0_1") == [0, 1] and missing("0_2") == missing("1_2") == [0, 1, 6, 7, 8]
    nobody = [r for r in full if r[1] != at(6)]  # no unit has the time: windows span it
    d = detect.compute_pairwise_distances(spark.createDataFrame(nobody, schemas.SENSOR), 1, 3)
    assert d.count() == 33 and d.where("distance IS NULL").count() == 6
    fourth = nobody + [(0, at(6), 3, 1.0)]  # a unit that is in no pair has it
    d = detect.compute_pairwise_distances(spark.createDataFrame(fourth, schemas.SENSOR), 1, 3)
    assert d.count() == 36 and d.where("distance IS NULL").count() == 3 * 5
    smooth = detect.smoothed(detect.ingest(spark.createDataFrame(gone, schemas.SENSOR)), 3).where("unit = 2 AND TmpRet_smooth IS NULL")
    assert smooth.count() == 2  # an absent row doesn't break smoothing


def test_missing_units_and_keys(spark):
    rows = [(0, at(m), u, 1.0 * m * u) for u in (0, 1) for m in range(10)] + [(1, at(m), u, float("nan") if u == 2 else 1.0) for u in range(3) for m in range(10)] + [(None, at(0), 0, 1.0), (2, None, 0, 1.0), (2, at(0), None, 1.0)]
    df = spark.createDataFrame(rows, schemas.SENSOR)
    d = detect.compute_pairwise_distances(df, 2, 2)
    assert {(r["container_id"], r["pair"]) for r in d.select("container_id", "pair").distinct().collect()} == {(0, "0_1"), (1, "0_1")}
    flags, limits = detect.detect(df, 2, 2)
    assert flags.count() == 0 and limits.count() == 2  # no unit has both its pairs, yet each container has its threshold
    empty = detect.detect(df.where("false"), 2, 2)
    assert empty[0].collect() == [] and empty[1].collect() == []
    assert detect.compute_pairwise_distances(df, 20, 5).count() == 0  # fewer rows than the window


def test_duplicates_are_averaged(spark):
    rows = [(0, at(m), u, 1.0) for u in range(3) for m in range(6)] + [(0, at(5), 0, 3.0)]
    wide = detect.pivoted(spark.createDataFrame(rows, schemas.SENSOR), "TmpRet").where(F.col("timestamp_et") == at(5)).first()
    assert (wide["u0"], wide["u1"]) == (2.0, 1.0)


def test_one_exchange(ramp):
    """Rows are dealt out by container once for smoothing, pivot and pair windows."""
    plan = detect.wide_distances(ramp, SMOOTH, DISTANCE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "Python" not in plan


def test_zscores(spark):
    out = zscores(spark.createDataFrame([(0, T0, 0, 1.0), (0, T0, 0, 1.0)], schemas.SENSOR)).collect()
    assert all(r["score"] is None and not r["flagged"] for r in out)


def test_other_units(spark):
    rows = [(0, at(m), u, 50.0 + (9 if u == 3 and m > 20 else 0) + 0.01 * math.sin(m * (u + 1))) for u in range(4) for m in range(60)]
    flags, _ = detect.detect(spark.createDataFrame(rows, schemas.SENSOR), 2, 5, "iqr", 0, units=(0, 1, 2, 3))
    assert "dist_3" in flags.columns and flags.where("unit = 3 AND anomaly_flag").count() > 0


@pytest.mark.parametrize("minutes", [3, 7, 1000])
def test_chunks_give_the_same_rows(spark, minutes):
    """Gaps longer than chunks, units with rows of their own, ties: chunks shorter than the windows and longer than the series."""
    rows = [(c, at(m), u, float((m * 7 + u * 3 + c) % 11)) for c in (0, 1) for u in range(3) for m in range(60) if (m * 5 + u) % 7 and not 20 < m < 31] + [(0, at(5), 0, 1.0), (0, at(40), 1, None), (1, at(33), 2, float("nan"))]
    df = spark.createDataFrame(rows, schemas.SENSOR)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(detect.smoothed(df, 4, chunk_minutes=minutes), detect.smoothed(df, 4))
    tidy = lambda x: x.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in x.dtypes))
    for strategy in ("mad", "iqr"):
        for a, b in zip(detect.detect(df, 3, 5, strategy, 1, chunk_minutes=minutes), detect.detect(df, 3, 5, strategy, 1), strict=True):
            assert same(tidy(a), tidy(b))


def test_one_long_container_is_many_tasks(spark):
    rows = spark.range(3 * 20_000).select(F.lit(1).cast("long").alias("container_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id div 3 AS int))").alias("timestamp_et"), (F.col("id") % 3).alias("unit"), (F.col("id") % 17).cast("double").alias("TmpRet"))
    chunked = detect.wide_distances(rows, SMOOTH, DISTANCE, chunk_minutes=500)
    full = lambda x: x.groupBy(F.spark_partition_id()).count().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        x = with_overlap(rows, ["container_id", "unit"], ["timestamp_et"], chunk_of("timestamp_et", 500), SMOOTH - 1)
        dealt = x.withColumn("m", F.avg("TmpRet").over(in_chunk(["container_id", "unit"], ["timestamp_et"]).rowsBetween(-1, 0)))
        assert full(dealt) >= 4 and chunked.count() == 20_000 - SMOOTH + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
