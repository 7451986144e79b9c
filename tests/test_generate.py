"""The synthetic fleet, injections, evaluation, reports, loaders and streams."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import baselines, detect, evaluate, inject, report
from fleetspark.plans import oracles, queries
from fleetspark.sources import generate, loaders, schemas
from fleetspark.streaming import day_maxima, flag_stream

START = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def fleet(spark):
    return generate.generate_fleet(spark, 3, START, 3, 1.0, seed=3).cache()


def test_fleet(spark, fleet):
    assert fleet.columns == [f.split()[0] for f in schemas.GENERATED.split(", ")]
    assert fleet.count() == 3 * 3 * 3 * 1440
    assert fleet.where("anomaly <> (anomaly_type <> 'normal')").count() == 0
    per = fleet.groupBy("container_id", "unit").agg(F.countDistinct("timestamp_et").alias("n"), F.min("timestamp_et").alias("a"), F.max("timestamp_et").alias("b")).collect()
    assert len(per) == 9 and all(r["n"] == 3 * 1440 and r["a"] == dt.datetime(2026, 1, 1) and r["b"] == dt.datetime(2026, 1, 3, 23, 59) for r in per)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = generate.generate_fleet(spark, 3, START, 3, 1.0, seed=3)
        assert again.exceptAll(fleet).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    clean = generate.generate_fleet(spark, 2, START, 1, 0.0)
    low, high = clean.agg(F.min("TmpRet"), F.max("TmpRet")).first()
    assert clean.where("anomaly").count() == 0 and 44.9 < low < high < 70.1


def test_pattern_against_slices(spark):
    rng, days = np.random.default_rng(4), 2
    cycles = [(0, i, int(s), int(s + n), float(p), float(b)) for i, (s, n, p, b) in enumerate(zip(rng.integers(-30, 2870, 25), rng.integers(5, 900, 25), rng.uniform(0.85, 1, 25), rng.uniform(-0.15, 0.15, 25), strict=True))]
    offset = 7
    want = np.zeros(days * 1440)
    for _, _, s, e, p, b in cycles:
        s, e = s + offset, min(e + offset, len(want))
        if s < 0 or s >= len(want) or e - s < 20:
            continue
        rise = max(5, min(int((e - s) * 0.065), e - s - 5))
        want[s:e] = np.concatenate([np.linspace(0, 1, rise) ** 0.2, np.linspace(1, 0, e - s - rise) ** 3.5]) * p + b
    offsets = spark.createDataFrame([(0, 0, offset)], "container_id long, unit long, minute_offset int")
    got = np.zeros(days * 1440)
    for r in generate.charge_pattern(spark.createDataFrame(cycles, schemas.CYCLES), offsets, days).collect():
        got[r["pos"]] = r["pattern"]
    assert np.allclose(got, np.clip(want, 0, 1), atol=1e-9)


def injected(spark, values, anomalies, **more):
    rows = [(0, u, i, v, False, "normal") for u, own in enumerate(values) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "container_id long, unit long, pos int, TmpRet double, anomaly boolean, anomaly_type string")
    out = inject.inject_sequence(df, spark.createDataFrame([(0, i, *a) for i, a in enumerate(anomalies)], schemas.ANOMALIES), **more).orderBy("unit", "pos").collect()
    n = len(values[0])
    return [[r["TmpRet"] for r in out[u * n : (u + 1) * n]] for u in range(len(values))], [[r["anomaly_type"] for r in out[u * n : (u + 1) * n]] for u in range(len(values))]


def test_injections_against_slices(spark):
    rng = np.random.default_rng(5)
    values = [rng.uniform(40, 60, 400).tolist() for _ in range(3)]
    for multiplier, (start, hours) in itertools.product((2.0, 0.4, 1.2, 0.2), ((0, 2), (5, 3))):
        want, s = [list(v) for v in values], start * 60
        seg = np.array(want[1][s : s + hours * 60])
        new = np.interp(np.linspace(0, len(seg) - 1, int(len(seg) / multiplier)), np.arange(len(seg)), seg)
        want[1][s : s + len(seg)] = np.resize(new, len(seg)) if len(new) < len(seg) else new[: len(seg)]
        got, kinds = injected(spark, values, [(1, "frequency", 0, start, hours, None, None, multiplier)])
        assert np.allclose(got, want) and sum(k == "frequency" for k in kinds[1]) == len(seg) and set(kinds[0]) == {"normal"}
        if multiplier != 2.0:
            break


def test_injections_in_order(spark):
    values = [[50.0 + i % 60 + u for i in range(400)] for u in range(3)]
    got, kinds = injected(spark, values, [(1, "lag", 0, 2, 2, 60, None, None), (0, "amplitude", 0, 3, 9, None, 0.5, None), (0, "stuck", 0, 0, 1, None, None, None), (2, "lag", 0, 1, 1, 90, None, None), (2, "lag", 0, 9, 1, 90, None, None)])
    want = [list(v) for v in values]
    want[1][120:240] = want[1][60:180]
    want = [v[:180] + [50 + (x - 50) * 0.5 for x in v[180:]] for v in want]
    assert np.allclose(got, want)
    assert kinds[2][60:120] == ["lag"] * 60  # too early to reach back: labels without values
    assert set(kinds[0][180:]) == {"amplitude"} and set(kinds[1][120:180]) == {"lag"} and set(kinds[1][:120]) == {"normal"}
    with pytest.raises(ValueError, match="Unknown anomaly type"):
        injected(spark, values, [(0, "stuck", 0, 0, 1, None, None, None)], strict=True)


def brute(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    roc = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None
    pr = sum((sum(x == s for x in p) / len(p)) * sum(x >= s for x in p) / sum(x >= s for x, _ in rows) for s in set(p)) if p else None
    return pr, roc


@pytest.mark.parametrize("rows", [[(0.1 * (i * 7 % 23), i % 3 == 0) for i in range(200)], [(1.0, True), (1.0, False)], [(1.0, True)], [(2.0, False)], [(float(i), i > 50) for i in range(99)]])
def test_ranking_metrics(spark, rows):
    df = spark.createDataFrame([(s, int(y), "g") for s, y in rows] + [(None, 1, "g"), (float("nan"), 1, "g"), (1.0, None, "g")], "anomaly_score double, label int, g string")
    for by in ((), ("g",)):
        r = evaluate.ranking_metrics(df, by=by).first()
        assert (r["auc_pr"], r["auc_roc"]) == pytest.approx(brute(rows)) and r["positives"] == sum(y for _, y in rows)


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "anomaly_score double, label int")
    assert all(r["auc_pr"] is None and r["auc_roc"] is None for r in evaluate.ranking_metrics(df).collect())


@pytest.mark.parametrize(("errors", "days"), [([1, 1, 1], (8, 0)), ([0, 0, 0], (0, 8)), ([0, 1, 0], (4, 4)), ([], (None, None))])
def test_results_table_against_sql(spark, tmp_path, errors, days):
    """Days of one class or none leave a metric undefined, which is no value outside its range."""
    duckdb = pytest.importorskip("duckdb")
    t0 = dt.datetime(2024, 1, 4)  # the windows fill on the first day
    rows = [(e, t0 + dt.timedelta(hours=6 * (e // 12), minutes=e % 12), (e // 3) % 4, "error" if errors[e // 48] else "view", 200.0 + e * e * 7 % 31) for e in range(48 * len(errors))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("event_metrics", "results_table_shape"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        found = con.sql(oracles.ORACLES[name]).select(*(duckdb.ColumnExpression(c) for c in df.columns)).fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(found, key=repr)
    assert {(r[0], r[-1]) for r in got} == {("distance", 1), ("random", 1)} and got[0][1:3] == days


def test_undefined_metrics_only_where_classes_say_so(spark, monkeypatch):
    """A null or a value out of range where both classes are there is not within."""
    rows = [("a", None, 0.5, 2, 3), ("b", 0.5, None, 2, 3), ("c", 0.5, 1.5, 2, 3), ("d", 0.5, 0.5, 2, 3), ("e", 1.0, None, 2, 0), ("f", 1.0, 0.5, 2, 0), ("g", None, None, 0, 3), ("h", None, None, None, None)]
    monkeypatch.setattr(queries, "_results", lambda s, d: s.createDataFrame(rows, "method string, auc_pr double, auc_roc double, positives long, negatives long"))
    got = {r["method"]: r["within"] for r in queries.QUERIES["results_table_shape"](spark, "").collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 0, "g": 1, "h": 1}


def test_random_scorer_is_chance(spark):
    df = baselines.random_scores(spark.range(4000).withColumn("label", (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int")), "id")
    assert abs(evaluate.ranking_metrics(df, "score").first()["auc_roc"] - 0.5) < 0.03


def test_breakdown(spark):
    df = spark.createDataFrame([(1.0, 1, "a", 0.5), (2.0, 0, "a", 3.0), (3.0, 1, "b", None), (0.0, 0, "b", 9.0)], "anomaly_score double, label int, mode string, lead double")
    df = df.withColumn("lead", evaluate.lead_time_bucket(F.col("lead")))
    got = {(r["stratum"], r["value"]): r["auc_roc"] for r in evaluate.metric_breakdown(df, ("mode", "lead")).collect()}
    assert got[("mode", "a")] == 0 and got[("mode", "b")] == 1 and got[("lead", "none")] is None and len(got) == 6
    assert {(r["column"], r["value"]): r["n"] for r in evaluate.label_distribution(df, ("mode", "label")).collect()} == {("mode", "a"): 2, ("mode", "b"): 2, ("label", "0"): 2, ("label", "1"): 2}


def test_unit_day_labels(spark):
    a = spark.createDataFrame([(0, 0, 1, "lag", 0, 23, 2, 60, None, None), (1, 0, 0, "amplitude", 1, 0, 24, None, 0.3, None)], schemas.ANOMALIES)
    got = {(r["container_id"], r["unit"], r["day"].day) for r in evaluate.unit_day_labels(a, START).collect()}
    assert got == {(0, 1, 1), (0, 1, 2), (1, 0, 2), (1, 1, 2), (1, 2, 2)}


def test_methods_compared(spark):
    """A lag parts one unit from the others, which the distance sees; forest and reconstruction error score every time."""
    a = spark.createDataFrame([(0, 0, 1, "lag", 1, 6, 12, 180, None, None)], schemas.ANOMALIES)
    fleet = generate.generate_fleet(spark, 1, START, 3, anomalies=a)
    scored = detect.unit_scores(detect.detect(fleet)[0])
    assert scored.where("anomaly_flag <> coalesce(score > 1e300, false) AND score IS NULL").count() == 0
    top = scored.where("unit = 1").orderBy(F.desc("score")).first()
    assert dt.datetime(2026, 1, 2, 6) <= top["timestamp_et"] <= dt.datetime(2026, 1, 2, 20)
    small = fleet.where("minute(timestamp_et) % 10 = 0")
    for scores in (baselines.isolation_forest(small, trees=10), baselines.pca_errors(small)):
        assert scores.count() == 3 * 1440 / 10 and scores.where("score IS NULL OR score < 0").count() == 0


def test_isolation_scores():
    x = np.random.default_rng(0).normal(size=(600, 3))
    x[0] = 9.0
    s = baselines.isolation_scores(x, 1)
    assert s.argmax() == 0 and (s == baselines.isolation_scores(x, 1)).all() and baselines.isolation_scores(x[:1], 1).tolist() == [0.5]


def test_reports(spark, fleet):
    kind = fleet.where("anomaly").first()["anomaly_type"]
    lines = report.plot_series(fleet, kind, 5)
    ids = {r["container_id"] for r in lines.select("container_id").distinct().collect()}
    assert ids == {r["container_id"] for r in fleet.where(F.col("anomaly_type") == kind).select("container_id").distinct().collect()}
    assert lines.where("kind = 'line'").count() == len(ids) * 3 * 3 * 1440
    assert report.plot_series(fleet, "none such").collect() == []
    share = report.type_distribution(report.unit_day(fleet)).collect()
    assert abs(sum(r["percentage"] for r in share) - 100) < 0.1
    eighth = spark.createDataFrame([("a", "1")] + [("b", str(i)) for i in range(799)], "anomaly_type string, cont_unit_day string")
    assert {r["anomaly_type"]: r["percentage"] for r in report.type_distribution(eighth).collect()}["a"] == 0.12  # half to even
    assert report.title("lag") == "Lag anomalies"


def test_csv_round_trip(spark, fleet, tmp_path):
    some = fleet.where("container_id = 0 AND unit = 0").limit(50)
    loaders.write_csv(some, f"{tmp_path}/timeseries/s1.csv")
    back = loaders.load_timeseries(spark, str(tmp_path), "s1")
    assert back.count() == 50 and back.exceptAll(some).isEmpty()
    with pytest.raises(Exception, match="(?i)path"):
        loaders.load_timeseries(spark, str(tmp_path), "none")
    labels = spark.createDataFrame([("s1", 1, "leak", "field", "v1", 3, 0.9, "n"), ("s2", 0, None, "lab", "v1", None, None, None)], schemas.LABELS)
    loaders.write_csv(labels, f"{tmp_path}/labels.csv")
    assert loaders.load_labels(spark, str(tmp_path), "lab").count() == 1
    series = spark.createDataFrame([("s1",), ("s3",)], "system_id string")
    joined = {r["system_id"]: r["label"] for r in loaders.load_dataset(series, loaders.load_labels(spark, str(tmp_path))).collect()}
    assert joined == {"s1": 1, "s3": None}


def test_stream(spark, tmp_path):
    rows = [(0, dt.datetime(2026, 1, 1, h), 1, float(h)) for h in range(5)] + [(9, dt.datetime(2026, 1, 1), 1, 99.0)]
    spark.createDataFrame(rows, "container_id long, timestamp_et timestamp, unit long, score double").write.parquet(f"{tmp_path}/in")
    limits = spark.createDataFrame([(0, 2.5, "mad")], "container_id long, threshold double, strategy string")
    stream = spark.readStream.schema("container_id long, timestamp_et timestamp, unit long, score double").parquet(f"{tmp_path}/in")
    q = flag_stream(stream, limits).writeStream.format("memory").queryName("flagged").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM flagged WHERE anomaly_flag").first()[0] == 2
    q = day_maxima(stream).writeStream.format("memory").queryName("maxima").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["container_id"]: r["anomaly_score"] for r in spark.sql("SELECT * FROM maxima").collect()} == {0: 4.0, 9: 99.0}


def test_mixed_fleet_and_one_container(spark):
    explicit = spark.createDataFrame([(1, 0, 2, "lag", 0, 1, 2, 30, None, None)], schemas.ANOMALIES)
    mixed = generate.generate_fleet(spark, 4, START, 3, 1.0, explicit, clean=[3])
    drawn = generate.generate_fleet(spark, 4, START, 3, 1.0)
    kinds = {c: {r["anomaly_type"] for r in mixed.where((F.col("container_id") == c) & F.col("anomaly")).select("anomaly_type").distinct().collect()} for c in range(4)}
    assert kinds[1] == {"lag"} and kinds[3] == set() and len(kinds[0]) == len(kinds[2]) == 1
    for c in (0, 2):  # the draw of a container doesn't depend on the others
        a, b = (x.where(F.col("container_id") == c) for x in (mixed, drawn))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    one = generate.generate_container(spark, 1, START, 3, explicit)
    assert one.exceptAll(mixed.where("container_id = 1")).isEmpty() and one.count() == 3 * 3 * 1440
    keys = [(r["timestamp_et"], r["unit"]) for r in one.select("timestamp_et", "unit").collect()]
    assert keys == sorted(keys)


def test_unit_day_share(spark):
    rows = [("2024-01-01 01:00:00", 0, True, "lag"), ("2024-01-01 02:00:00", 0, True, "amplitude"), ("2024-01-01 02:00:00", 1, False, "normal"), ("2024-01-02 01:00:00", 0, False, "normal"), ("2024-01-02 01:00:00", 1, True, "lag"), ("2024-01-02 03:00:00", 1, False, "normal"), (None, 1, True, "lag")]
    df = spark.createDataFrame(rows, "t string, unit long, anomaly boolean, anomaly_type string").select("unit", "anomaly", "anomaly_type", F.lit(5).alias("container_id"), F.to_timestamp_ntz("t").alias("timestamp_et"))
    got = {r["anomaly_type"]: (r["unit_days"], r["percentage"]) for r in report.unit_day_share(report.unit_day(df)).collect()}
    assert got == {"lag": (2, 50.0), "amplitude": (1, 25.0)}


def test_stratified_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("hash"), F.when(F.col("id") % 100 < 98, "big").when(F.col("id") % 100 < 99, "small").alias("kind"))
    picked = evaluate.stratified_sample(df, ("kind",), 60, ("hash",))
    assert picked.columns == df.columns and {r["kind"]: r["count"] for r in picked.groupBy("kind").count().collect()} == {"big": 60, "small": 50, None: 50}
    again = evaluate.stratified_sample(df.repartition(7), ("kind",), 60, ("hash",))
    assert again.exceptAll(picked).isEmpty() and again.where("kind = 'big'").agg(F.max("hash")).first()[0] > 2500


def test_forest_scores_do_not_depend_on_batches(spark):
    x = np.random.default_rng(2).normal(size=(300, 3))
    whole = baselines.isolation_scores(x, 9, 10, pool=x[:100])
    assert np.array_equal(np.concatenate([baselines.isolation_scores(p, 9, 10, pool=x[:100]) for p in (x[:7], x[7:250], x[250:])]), whole)


def test_report_data(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, 1.5), (1, 1, 6.0, None)], "container_id long, unit long, TmpRet double, score double").withColumn("timestamp_et", F.to_timestamp_ntz(F.lit(START)))
    overlay = report.score_overlay(rows, rows).collect()
    assert sorted((r["trace"], r["axis"], r["y"]) for r in overlay if r["y"] is not None) == [("score of unit 0", "y2", 1.5), ("unit 0", "y", 5.0), ("unit 1", "y", 6.0)]
    flags = rows.where("unit = 1").select("container_id", "unit", "timestamp_et", F.lit(True).alias("anomaly_flag"))
    assert [(r["unit"], r["flagged"]) for r in report.flagged_series(rows, flags.unionAll(flags)).orderBy("unit").collect()] == [(0, False), (1, True)]
    bars = report.grouped_bars(spark.createDataFrame([("a", 0.5, None)], "method string, auc_pr double, auc_roc double")).collect()
    assert [tuple(b) for b in bars] == [("a", "auc_pr", 0.5)]
