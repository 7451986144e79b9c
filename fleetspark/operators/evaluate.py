"""Evaluation on days: scores, labels, average precision, ROC area, and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of scores over which the ordered sums are spread.
RANGES = 64


def day_scores(scores: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ("container_id",)) -> DataFrame:
    """by, day, anomaly_score, label: the greatest of a day; days without a score are left out."""
    days = scores.groupBy(*by, F.to_date("timestamp_et").alias("day")).agg(F.max(score).alias("anomaly_score"), F.max(label).alias("label"))
    return days.where("anomaly_score IS NOT NULL")


def unit_day_labels(anomalies: DataFrame, start_time: str, units=(0, 1, 2), days: int | None = None) -> DataFrame:
    """container_id, unit, day, anomaly_type: every day of a unit that an anomaly (schemas.ANOMALIES) touches; an amplitude touches all units."""
    t0 = F.to_timestamp_ntz(F.lit(start_time))
    start = t0 + F.make_dt_interval(days=F.coalesce("start_day", F.lit(0)), hours=F.coalesce("start_hour", F.lit(0)))
    end = start + F.make_dt_interval(hours=F.coalesce("duration_hours", F.lit(1)), mins=F.lit(-1))
    if days is not None:
        end = F.least(end, t0 + F.make_dt_interval(days=F.lit(days), mins=F.lit(-1)))
    whom = F.when(F.col("type") == "amplitude", F.array(*(F.lit(u).cast("long") for u in units))).otherwise(F.array(F.col("unit").cast("long")))
    a = anomalies.select("container_id", "type", start.alias("s"), end.alias("e"), F.explode(whom).alias("unit")).where("s <= e")
    a = a.select("container_id", "unit", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))).alias("day"), F.col("type").alias("anomaly_type"))
    return a.distinct()


def ranking_metrics(scored: DataFrame, score: str = "anomaly_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """by, auc_pr, auc_roc, positives, negatives of binary labels; rows without a score or label are left out.

    auc_pr is the average precision, ties of the score counted together; auc_roc the chance that a positive scores
    higher, ties counting half; both are null without a positive, auc_roc also without a negative.

    Counts are first taken per distinct score; these are dealt to ranges of scores, so that the running sums over the
    order are sums of the ranges before and a window within a range, and no task orders all scores.
    """
    x = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    per = x.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))  # positives and all of a score
    cuts = per.groupBy(*by).agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"), F.sum("p").cast("long").alias("all_p"), F.sum("n").cast("long").alias("all_n"))
    per = per.join(cuts, list(by)) if by else per.crossJoin(F.broadcast(cuts))  # one row without by
    per = per.withColumn("r", F.size(F.filter("cuts", lambda c: c <= F.col("s")))).drop("cuts")
    ranges = per.groupBy(*by, "r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    below = Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    ranges = ranges.select(*by, "r", F.coalesce(F.sum("rp").over(below), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(below), F.lit(0)).alias("bn"))
    inside = Window.partitionBy(*by, "r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(ranges, [*by, "r"]).withColumns({"lp": F.col("bp") + F.coalesce(F.sum("p").over(inside), F.lit(0)), "ln": F.col("bn") + F.coalesce(F.sum("n").over(inside), F.lit(0))})
    # at or above a score: all but those below it
    tp, fetched = F.col("all_p") - F.col("lp"), F.col("all_n") - F.col("ln")
    precision = F.try_divide(F.col("p") * tp, fetched * F.col("all_p"))
    pairs = F.col("p") * ((F.col("ln") - F.col("lp")) + (F.col("n") - F.col("p")) / 2.0)
    return per.groupBy(*by).agg(F.sum(precision).alias("auc_pr"), F.sum(pairs).alias("w"), F.max("all_p").alias("positives"), (F.max("all_n") - F.max("all_p")).alias("negatives")).select(*by, "auc_pr", F.try_divide("w", F.col("positives") * F.col("negatives")).alias("auc_roc"), "positives", "negatives")


def metric_breakdown(scored: DataFrame, strata: tuple[str, ...], score: str = "anomaly_score", label: str = "label") -> DataFrame:
    """stratum, value, auc_pr, auc_roc, positives, negatives: the metrics within each value of each stratum; all rows come once for each."""
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata)))
    long = scored.select(F.col(score), F.col(label), rows.alias("x")).select(score, label, "x.stratum", F.coalesce("x.value", F.lit("none")).alias("value"))
    return ranking_metrics(long, score, label, ("stratum", "value"))


def label_distribution(labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, value, n: counts of each value of each column, in one pass."""
    sets = ", ".join(f"({c})" for c in columns)
    name = F.coalesce(*(F.when(F.expr(f"grouping({c}) = 0"), F.lit(c)) for c in columns)).alias("column")
    return labels.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), name, F.coalesce(*(F.col(c).cast("string") for c in columns)).alias("value")).select("column", "value", "n") if sets else labels


def stratified_sample(df: DataFrame, strata: tuple[str, ...], n: int, keys: tuple[str, ...], seed: int = 42) -> DataFrame:
    """df's rows and columns, at most n of each stratum, in the order of a hash of keys: the same ones for any partitioning.

    Null strata are strata too. Rows beyond four times their share of a stratum go before the sort, so that a stratum
    with most of the rows is as little work for one task as any other.
    """
    taken = {c.lower() for c in df.columns}
    names = {}
    for name in ("hash", "size", "rank"):
        while name in taken:
            name += "_"
        taken.add(name)
        names[len(names)] = name
    h, size, rank = names.values()
    order = F.xxhash64(F.lit(seed), *keys)
    sizes = df.groupBy(*(F.col(c).alias(f"{h}{i}") for i, c in enumerate(strata))).agg(F.count("*").alias(size))  # a row a stratum
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"{h}{i}"))
    x = df.withColumn(h, order).join(sizes, same)
    x = x.where((F.col(size) <= 4 * n) | ((F.col(h) / float(1 << 64) + 0.5) * F.col(size) < 4 * n + 40))
    x = x.withColumn(rank, F.row_number().over(Window.partitionBy(*(f"{h}{i}" for i in range(len(strata)))).orderBy(h, *keys)))
    return x.where(F.col(rank) <= n).select(*df.columns)


def lead_time_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days < 1, "under 1 day").when(days < 7, "1 to 7 days").otherwise("7 days or more")


def results_table(metrics: dict[str, DataFrame]) -> DataFrame:
    """One frame from the metrics of several methods, with the method's name first."""
    out = None
    for method, df in metrics.items():
        own = df.select(F.lit(method).alias("method"), *df.columns)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no method to compare")
    return out
