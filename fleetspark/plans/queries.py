"""One query per operator, over the events, documents and labels tables or literal tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions.rolling import rolling_euclidean_distance
from fleetspark.operators import baselines, detect, evaluate, inject, report
from fleetspark.sources import generate, loaders, schemas
from fleetspark.sources.fixtures import sensor_dense, sensor_gappy, table
from fleetspark.sources.storage import shared_folder

SMOOTH, DISTANCE = 5, 30
GAPPY_SMOOTH, GAPPY_DISTANCE = 2, 4
#: container, cycle, start, end, peak, baseline: overlaps, a start before 0 and an end past the day for unit 1, one too short.
CYCLES = [(0, 0, 3, 300, 0.9, 0.1), (0, 1, 250, 700, 1.0, -0.1), (0, 2, 690, 705, 0.95, 0.0), (0, 3, 1000, 1439, 0.85, 0.05), (1, 0, 30, 52, 0.9, 0.15), (1, 1, 40, 1200, 0.97, -0.12)]
#: container, unit, minute offset, temperature offset.
OFFSETS = [(0, 0, 0, 0.5), (0, 1, -5, -1.25), (0, 2, 7, 2.0), (1, 0, 0, -0.5), (1, 1, 9, 0.25), (1, 2, -10, 1.0)]
DAY_OFFSETS = [(0, 0, 1.5), (1, 0, -2.25)]
#: container, seq, unit, type, start_day, start_hour, duration_hours, lag, scale, multiplier.
ANOMALIES = {
    "lag": [(0, 0, 1, "lag", 0, 3, 2, 60, None, None), (1, 0, 2, "lag", 0, 5, 48, 45, None, None)],
    "lag_early": [(0, 0, 1, "lag", 0, 0, 2, 60, None, None)],
    "amplitude": [(0, 0, 1, "amplitude", 0, 2, 3, None, 0.3, None), (2, 0, 0, "amplitude", 0, 12, 24, None, 0.25, None)],
    "frequency_fast": [(0, 0, 1, "frequency", 0, 2, 3, None, None, 2.0)],
    "frequency_slow": [(0, 0, 2, "frequency", 0, 2, 3, None, None, 0.4)],
    "sequence": [(0, 0, 1, "lag", 0, 3, 2, 60, None, None), (0, 1, 1, "amplitude", 0, 4, 2, None, 0.3, None), (0, 2, 1, "frequency", 0, 4, 3, None, None, 1.2), (3, 0, 0, "stuck", 0, 1, 1, None, None, None)],
}
START = "2024-01-01 00:00:00"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as sums in another order differ in the last ones; dates as text."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def anomalies(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ANOMALIES[name], schemas.ANOMALIES)


def _smoothed(spark, d):
    return rounded(detect.smoothed(detect.ingest(sensor_dense(spark, d)), SMOOTH))


def _rolling_distance(spark, d):
    unit = lambda u: sensor_dense(spark, d).where(F.col("unit") == u).select("container_id", "timestamp_et", F.col("TmpRet").alias("value"))
    return rounded(rolling_euclidean_distance(unit(0), unit(1), DISTANCE, "timestamp_et", by=["container_id"]))


def _pivot(spark, d):
    return rounded(detect.pivoted(detect.smoothed(detect.ingest(sensor_dense(spark, d)), SMOOTH)))


def _pairs(spark, d):
    return rounded(detect.compute_pairwise_distances(sensor_dense(spark, d), SMOOTH, DISTANCE))


def _pairs_gappy(spark, d):
    return rounded(detect.compute_pairwise_distances(sensor_gappy(spark, d), GAPPY_SMOOTH, GAPPY_DISTANCE))


def _threshold(strategy):
    return lambda spark, d: rounded(detect.thresholds(detect.compute_pairwise_distances(sensor_dense(spark, d), SMOOTH, DISTANCE), strategy))


def _flags(strategy, k, view=sensor_dense, windows=(SMOOTH, DISTANCE)):
    return lambda spark, d: rounded(detect.detect(view(spark, d), *windows, strategy, k)[0])


def _pairs_chunked(spark, d):
    return rounded(detect.compute_pairwise_distances(sensor_dense(spark, d), SMOOTH, DISTANCE, chunk_minutes=100))


def _flags_chunked(view, windows, minutes):
    return lambda spark, d: rounded(detect.detect(view(spark, d), *windows, "mad", 1, chunk_minutes=minutes)[0])


def _flags_of_long(spark, d):
    return rounded(detect.flag_anomalies(detect.compute_pairwise_distances(sensor_dense(spark, d), SMOOTH, DISTANCE), "mad", 1)[0])


def _flag_counts(spark, d):
    flags = detect.detect(sensor_dense(spark, d), SMOOTH, DISTANCE, "mad", 1)[0]
    return flags.groupBy("container_id", "unit").agg(F.count("*").alias("rows"), F.sum(F.col("anomaly_flag").cast("int")).alias("flagged"))


def _cycles(spark):
    return spark.createDataFrame(CYCLES, schemas.CYCLES), spark.createDataFrame(OFFSETS, "container_id long, unit long, minute_offset int, temperature_offset double")


def _charge(spark, d):
    return rounded(generate.charge_pattern(*_cycles(spark), days=1))


def _normal(spark, d):
    cycles, offsets = _cycles(spark)
    days = spark.createDataFrame(DAY_OFFSETS, "container_id long, day long, daily_offset double")
    return rounded(generate.normal_units(generate.minute_grid(spark, 2, 1), generate.charge_pattern(cycles, offsets, 1), offsets, days))


def _injected(name):
    def query(spark, d):
        series = inject.with_position(sensor_dense(spark, d)).withColumns({"anomaly": F.lit(False), "anomaly_type": F.lit("normal")})
        return rounded(inject.inject_sequence(series, anomalies(spark, name)).select("container_id", "unit", F.col("pos").cast("long").alias("pos"), "TmpRet", "anomaly", "anomaly_type"))

    return query


def _day_scores(spark, d):
    scored = detect.unit_scores(detect.detect(sensor_gappy(spark, d), GAPPY_SMOOTH, GAPPY_DISTANCE, "mad", 1)[0])
    errors = table(spark, d, "events").select((F.col("user_id") % 4).alias("container_id"), F.to_date("ts").alias("day"), ((F.col("event_type") == "error") & (F.col("value") > 150)).cast("int").alias("e"))
    truth = errors.groupBy("container_id", "day").agg(F.max("e").alias("truth"))
    rows = scored.withColumn("day", F.to_date("timestamp_et")).join(truth, ["container_id", "day"]).withColumn("label", F.col("truth"))
    return evaluate.day_scores(rows)


def _unit_days(spark, d):
    return rounded(evaluate.unit_day_labels(anomalies(spark, "sequence").unionByName(anomalies(spark, "lag")), START, days=2))


def _metrics_of_days(spark, d):
    return rounded(evaluate.ranking_metrics(_day_scores(spark, d)))


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return loaders.load_dataset(table(spark, d, "documents").drop("text"), table(spark, d, "labels"), "doc_id")


def _metric_of_labels(column):
    return lambda spark, d: rounded(evaluate.ranking_metrics(labelled_documents(spark, d), "n_chars", "toxic")).select(column, "positives", "negatives")


def _breakdown(spark, d):
    return rounded(evaluate.metric_breakdown(labelled_documents(spark, d), ("lang", "source"), "n_chars", "toxic"))


def _label_distribution(spark, d):
    return evaluate.label_distribution(table(spark, d, "labels"), ("quality", "toxic"))


#: Event types as types of anomalies.
EVENT_TYPES = {"error": "amplitude", "view": "lag", "click": "frequency"}


def _events(spark, d):
    """Events as rows of schemas.GENERATED."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(k)) for e, k in EVENT_TYPES.items()), F.lit("normal"))
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("container_id"), (F.col("event_id") % 3).alias("unit"), F.col("ts").alias("timestamp_et"), F.col("value").alias("TmpRet"), kind.alias("anomaly_type"))
    return rows.withColumn("anomaly", F.col("anomaly_type") != "normal")


def _type_distribution(spark, d):
    return report.type_distribution(report.unit_day(_events(spark, d)))


def _plot(anomaly_type):
    return lambda spark, d: rounded(report.plot_series(_events(spark, d), anomaly_type, 2, None))


def _results(spark, d):
    days = _day_scores(spark, d)
    chance = baselines.random_scores(days.drop("anomaly_score"), "container_id", "day").withColumnRenamed("score", "anomaly_score")
    return rounded(evaluate.results_table({"distance": evaluate.ranking_metrics(days), "random": evaluate.ranking_metrics(chance)}))


def _fleet(spark, d):
    return generate.generate_fleet(spark, 4, START, 3, 0.5)


#: Explicit anomalies of containers 1 and 3; container 2 is clean, 0 left to the draw, which is certain.
MIXED = [(1, 0, 2, "lag", 0, 6, 5, 60, None, None), (3, 0, 0, "amplitude", 1, 2, 3, None, 0.3, None), (3, 1, 1, "frequency", 0, 4, 2, None, None, 2.0)]


def _fleet_mixed(spark, d):
    explicit = spark.createDataFrame(MIXED, schemas.ANOMALIES)
    rows = generate.generate_fleet(spark, 4, START, 4, 1.0, explicit, clean=[2])
    known = F.col("container_id").isin(1, 2, 3)
    return rows.groupBy("container_id", "unit").agg(F.count("*").alias("rows"), *(F.sum((known & (F.col("anomaly_type") == k)).cast("int")).alias(f"{k}_rows") for k in ("lag", "amplitude", "frequency")), (F.bool_or("anomaly") | F.lit(False)).alias("any")).select("container_id", "rows", "unit", "lag_rows", "amplitude_rows", "frequency_rows", F.when(known, F.col("any")).alias("any_anomaly"))


def _fleet_shape(spark, d):
    """What holds of every synthetic fleet, a row per container and unit."""
    rows = generate.generate_fleet(spark, 5, START, 3, 0.0)
    return rows.groupBy("container_id", "unit").agg(F.count("*").alias("rows"), F.countDistinct("timestamp_et").alias("times"), F.min("timestamp_et").cast("string").alias("first"), F.max("timestamp_et").cast("string").alias("last"), F.count_if(~F.col("TmpRet").between(44.5, 70.5)).alias("outside"), F.count_if("anomaly").alias("anomalies"))


def _cycle_shape(spark, d):
    """What holds of every day's cycles: three to five at most, none short, none past its day."""
    c = generate.cycle_timings(spark, 50, 10).withColumn("day", F.expr(f"cycle_start div {generate.DAY}"))
    days = c.groupBy("container_id", "day").agg(F.count("*").alias("n"), F.min(F.col("cycle_end") - F.col("cycle_start")).alias("least"), F.max(F.col("cycle_end") - (F.col("day") + 1) * generate.DAY).alias("over"), F.min("peak_intensity").alias("low"), F.max("peak_intensity").alias("high"), F.countDistinct("baseline_offset").alias("baselines"))
    return days.agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("days"), F.count_if(~F.col("n").between(1, 5)).alias("too_many"), F.count_if(F.col("least") < 20).alias("short"), F.count_if(F.col("over") > 0).alias("late"), F.count_if((F.col("low") < 0.85) | (F.col("high") > 1)).alias("odd_peaks"), F.count_if(F.col("baselines") != 1).alias("odd_baselines"))


def _chance(spark, d):
    """What holds of random scores: one for every row, within 0 and 1, their mean near a half."""
    s = baselines.random_scores(table(spark, d, "documents").select("doc_id"), "doc_id")
    return s.agg(F.count("*").alias("n"), F.count_if(~F.col("score").between(0, 1)).alias("outside"), (F.abs(F.avg("score") - 0.5) < 0.05).alias("centred"))


def _days_per_method(spark, d):
    """What holds of every results table: each metric lies within 0 and 1, and is null just where its classes leave it undefined."""
    r = _results(spark, d)
    positives, negatives = (F.coalesce(c, F.lit(0)) > 0 for c in ("positives", "negatives"))
    held = lambda c, defined: F.when(defined, F.coalesce(F.col(c).between(0, 1), F.lit(False))).otherwise(F.col(c).isNull())
    return r.groupBy("method").agg(F.max("positives").alias("positives"), F.max("negatives").alias("negatives"), F.count_if(held("auc_pr", positives) & held("auc_roc", positives & negatives)).alias("within"))


def _unit_day_share(spark, d):
    return report.unit_day_share(report.unit_day(_events(spark, d)))


def _lead_times(spark, d):
    docs = labelled_documents(spark, d).withColumn("lead_time_days", F.when(F.col("doc_id") % 10 != 9, (F.col("doc_id") % 10).cast("int")))
    return rounded(evaluate.metric_breakdown(docs.withColumn("lead_time", evaluate.lead_time_bucket(F.col("lead_time_days"))), ("lead_time",), "n_chars", "toxic"))


def _stratified(spark, d):
    picked = evaluate.stratified_sample(labelled_documents(spark, d), ("lang", "toxic"), 25, ("doc_id",))
    return picked.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("different"))


def _overlay(spark, d):
    rows = sensor_dense(spark, d)
    scores = detect.unit_scores(detect.detect(rows, SMOOTH, DISTANCE, "mad", 1)[0])
    return rounded(report.score_overlay(rows, scores))


def _flagged(spark, d):
    rows = sensor_dense(spark, d)
    return rounded(report.flagged_series(rows, detect.detect(rows, SMOOTH, DISTANCE, "mad", 1)[0]))


def _bars(spark, d):
    return rounded(report.grouped_bars(evaluate.metric_breakdown(labelled_documents(spark, d), ("lang",), "n_chars", "toxic"), "value"))


def _missing(spark, d):
    pairs = detect.compute_pairwise_distances(sensor_gappy(spark, d), GAPPY_SMOOTH, GAPPY_DISTANCE)
    return pairs.groupBy("container_id", "pair").agg(F.count("*").alias("n"), F.count_if(F.col("distance").isNull()).alias("missing"))


def _self_distances(spark, d):
    flags = detect.detect(sensor_dense(spark, d), SMOOTH, DISTANCE, "mad", 1)[0]
    own = F.coalesce(*(F.when(F.col("unit") == u, F.col(f"dist_{u}")) for u in detect.UNITS))
    return flags.groupBy("unit").agg(F.bool_and(own == 0).alias("all_zero"), F.count(own).alias("n"))


def _first_rows(spark, d):
    return sensor_dense(spark, d).orderBy("timestamp_et", "unit", "container_id").limit(25)  # the first rows are the feature


def _csv(spark, d):
    where = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    loaders.write_csv(sensor_dense(spark, d), where)
    return rounded(loaders.read_csv(spark, where, schemas.SENSOR))


def _iforest(spark, d):
    return baselines.isolation_forest(sensor_dense(spark, d))


def _pca(spark, d):
    return rounded(baselines.pca_errors(sensor_dense(spark, d)))


def _truth(spark, d):
    days = evaluate.unit_day_labels(anomalies(spark, "lag"), START, days=1).select("container_id", "day")
    return rounded(report.distances_with_truth(detect.compute_pairwise_distances(sensor_dense(spark, d), SMOOTH, DISTANCE), days))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rolling_mean_smooth": _smoothed,
    "rolling_distance": _rolling_distance,
    "pivot_units": _pivot,
    "pairwise_distances": _pairs,
    "pairwise_distances_gappy": _pairs_gappy,
    "threshold_mad": _threshold("mad"),
    "threshold_iqr": _threshold("iqr"),
    "threshold_mean_std": _threshold("mean_std"),
    "flag_units_mad": _flags("mad", 1),
    "flag_units_mad_of_long": _flags_of_long,
    "flag_units_iqr": _flags("iqr", 0),
    "flag_units_default_k": _flags("mad", None),
    "flag_units_gappy": _flags("mad", 1, sensor_gappy, (GAPPY_SMOOTH, GAPPY_DISTANCE)),
    "pairwise_distances_chunked": _pairs_chunked,
    "flag_units_chunked": _flags_chunked(sensor_dense, (SMOOTH, DISTANCE), 100),
    "flag_units_gappy_chunked": _flags_chunked(sensor_gappy, (GAPPY_SMOOTH, GAPPY_DISTANCE), 720),
    "flag_counts": _flag_counts,
    "charge_pattern": _charge,
    "normal_unit": _normal,
    **{f"inject_{name}": _injected(name) for name in ANOMALIES},
    "day_scores": lambda spark, d: rounded(_day_scores(spark, d)),
    "unit_day_labels": _unit_days,
    "event_metrics": _metrics_of_days,
    "event_auc_pr": _metric_of_labels("auc_pr"),
    "event_auc_roc": _metric_of_labels("auc_roc"),
    "metric_breakdown": _breakdown,
    "label_distribution": _label_distribution,
    "type_distribution": _type_distribution,
    "type_counts": lambda spark, d: report.type_counts(_events(spark, d)),
    "anomaly_rate": lambda spark, d: rounded(report.anomaly_rate(_events(spark, d))),
    "plot_series": _plot("amplitude"),
    "plot_markers": _plot("lag"),
    "distances_with_truth": _truth,
    "zscore_baseline": lambda spark, d: rounded(baselines.zscores(sensor_dense(spark, d), threshold=1.5)),
    "load_dataset": labelled_documents,
    "random_scorer": lambda spark, d: baselines.random_scores(table(spark, d, "labels").select("doc_id"), "doc_id"),
    "results_table": _results,
    "generated_fleet": _fleet,
    "generated_fleet_mixed": _fleet_mixed,
    "generated_fleet_shape": _fleet_shape,
    "cycle_shape": _cycle_shape,
    "random_scorer_shape": _chance,
    "results_table_shape": _days_per_method,
    "unit_day_share": _unit_day_share,
    "breakdown_by_lead_time": _lead_times,
    "stratified_sample": _stratified,
    "score_overlay": _overlay,
    "flagged_series": _flagged,
    "grouped_bars": _bars,
    "missing_distances": _missing,
    "self_distances": _self_distances,
    "first_rows": _first_rows,
    "csv_round_trip": _csv,
    "iforest_scores": _iforest,
    "pca_error": _pca,
}
