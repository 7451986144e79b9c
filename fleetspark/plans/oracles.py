"""The queries of fleetspark.plans.queries in DuckDB's SQL."""

from __future__ import annotations

from fleetspark.plans.queries import ANOMALIES, CYCLES, DAY_OFFSETS, DISTANCE, EVENT_TYPES, GAPPY_DISTANCE, GAPPY_SMOOTH, OFFSETS, SMOOTH

PAIRS = ((0, 1), (0, 2), (1, 2))

DENSE = """(SELECT user_id % 4 AS container_id, TIMESTAMP '2024-01-01' + (row_number() OVER (PARTITION BY user_id % 4, event_id % 3 ORDER BY ts, event_id) - 1) * INTERVAL 1 MINUTE AS timestamp_et,
  event_id % 3 AS unit, value AS TmpRet FROM events)"""
GAPPY = """(SELECT container_id, TIMESTAMP '1970-01-01' + bucket * INTERVAL 6 HOUR AS timestamp_et, unit, TmpRet FROM (
  SELECT user_id % 4 AS container_id, event_id % 3 AS unit, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS bucket, avg(value) AS TmpRet FROM events GROUP BY ALL) WHERE NOT (unit = 2 AND bucket % 20 = 0))"""


def values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "NULL" if v is None else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns}))"


def smooth(view: str, n: int) -> str:
    return f"(SELECT *, CASE WHEN count(TmpRet) OVER w = {n} THEN avg(TmpRet) OVER w END AS TmpRet_smooth FROM {view} WINDOW w AS (PARTITION BY container_id, unit ORDER BY timestamp_et ROWS {n - 1} PRECEDING))"


def pivot(view: str, n: int) -> str:
    cells = ", ".join(f"avg(TmpRet_smooth) FILTER (unit = {u}) AS u{u}" for u in range(3))
    return f"(SELECT container_id, timestamp_et, {cells} FROM {smooth(view, n)} WHERE TmpRet_smooth IS NOT NULL GROUP BY ALL)"


def wide(view: str, s: int, n: int) -> str:
    d = ", ".join(f"CASE WHEN count(u{i} - u{j}) OVER w = {n} THEN sqrt(sum((u{i} - u{j}) * (u{i} - u{j})) OVER w) END AS d{i}_{j}" for i, j in PAIRS)
    return f"(SELECT container_id, timestamp_et, {d} FROM {pivot(view, s)} WINDOW w AS (PARTITION BY container_id ORDER BY timestamp_et ROWS {n - 1} PRECEDING))"


def long(view: str = DENSE, s: int = SMOOTH, n: int = DISTANCE) -> str:
    return "(" + " UNION ALL ".join(f"SELECT container_id, timestamp_et, '{i}_{j}' AS pair, d{i}_{j} AS distance FROM {wide(view, s, n)}" for i, j in PAIRS) + ")"


def limits(strategy: str, k: float, view: str = DENSE, s: int = SMOOTH, n: int = DISTANCE) -> str:
    rule = {"mad": f"median(distance) + {k} * mad(distance) * 1.4826", "iqr": f"quantile_cont(distance, 0.75) + {k} * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))", "mean_std": f"avg(distance) + {k} * stddev(distance)"}[strategy]
    return f"(SELECT container_id, {rule} AS threshold, '{strategy}' AS strategy FROM {long(view, s, n)} GROUP BY container_id)"


def flags(strategy: str, k: float, view: str = DENSE, s: int = SMOOTH, n: int = DISTANCE) -> str:
    name = lambda x, y: f"d{min(x, y)}_{max(x, y)}"
    parts = []
    for u in range(3):
        fields = ", ".join(f"{'0.0::DOUBLE' if v == u else name(u, v)} AS dist_{v}" for v in range(3))
        over = " AND ".join(f"{name(u, v)} > threshold" for v in range(3) if v != u)
        parts.append(f"SELECT timestamp_et, container_id, {u}::BIGINT AS unit, {fields}, coalesce({over}, false) AS anomaly_flag, 'euclidean_distance_{strategy}' AS model FROM w JOIN t USING (container_id) WHERE {' OR '.join(f'd{i}_{j} IS NOT NULL' for i, j in PAIRS)}")
    return f"(WITH w AS {wide(view, s, n)}, t AS {limits(strategy, k, view, s, n)} {' UNION ALL '.join(parts)})"


def rounded(columns: str, doubles: str, source: str) -> str:
    return f"SELECT {columns}{', ' if columns else ''}{', '.join(f'round({c}, 6) AS {c}' for c in doubles.split(', '))} FROM {source}"


def flags_query(*args) -> str:
    return rounded("timestamp_et, container_id, unit, anomaly_flag, model", "dist_0, dist_1, dist_2", flags(*args))


CHARGE = f"""(
  SELECT container_id, unit, s + j AS pos, least(greatest(arg_max(v, cycle_idx), 0), 1)::DOUBLE AS pattern FROM (
    SELECT *, CASE WHEN j < rise THEN pow(j / (rise - 1), 0.2) ELSE pow(greatest(0, 1 - (j - rise) / (n - rise - 1)), 3.5) END * peak + base AS v FROM (
      SELECT *, unnest(range(0, n)) AS j FROM (
        SELECT *, greatest(5, least(CAST(trunc(n * 0.065) AS INTEGER), n - 5)) AS rise FROM (
          SELECT c.container_id, unit, cycle_idx, cs + mo AS s, least(ce + mo, 1440) - (cs + mo) AS n, peak, base
          FROM {values(CYCLES, "container_id, cycle_idx, cs, ce, peak, base")} c JOIN {values(OFFSETS, "container_id, unit, mo, temp")} o ON c.container_id = o.container_id)
        WHERE s >= 0 AND s < 1440 AND n >= 20)))
  GROUP BY container_id, unit, s + j)"""

NORMAL = f"""
SELECT g.container_id::BIGINT AS container_id, g.unit::BIGINT AS unit, g.pos::INTEGER AS pos, round(50 + o.temp + 15 * coalesce(p.pattern, 0) + d.off, 6) AS TmpRet
FROM (SELECT container_id, unit, unnest(range(0, 1440)) AS pos FROM {values(OFFSETS, "container_id, unit, mo, temp")}) g
LEFT JOIN {CHARGE} p ON g.container_id = p.container_id AND g.unit = p.unit AND g.pos = p.pos
JOIN {values(OFFSETS, "container_id, unit, mo, temp")} o ON g.container_id = o.container_id AND g.unit = o.unit
JOIN {values(DAY_OFFSETS, "container_id, day, off")} d ON g.container_id = d.container_id AND d.day = g.pos // 1440"""


def injected(name: str) -> str:
    steps: dict[int, list[tuple]] = {}
    seen: dict[int, int] = {}
    for c, _, unit, kind, day, hour, hours, lag, scale, multiplier in sorted(ANOMALIES[name]):
        if kind in ("lag", "amplitude", "frequency"):
            seen[c] = seen.get(c, 0) + 1
            steps.setdefault(seen[c], []).append((c, unit, kind, day * 1440 + hour * 60, hours * 60, 30 if lag is None else lag, 0.3 if scale is None else scale, 2.0 if multiplier is None else multiplier))
    ctes = [f"s0 AS (SELECT container_id, unit, row_number() OVER (PARTITION BY container_id, unit ORDER BY timestamp_et) - 1 AS pos, TmpRet, false AS anomaly, 'normal' AS anomaly_type FROM {DENSE})"]
    for k, rows in sorted(steps.items()):
        a = values(rows, "container_id, au, kind, st, mins, lag, scale, mult")
        ctes.append(f"""x{k} AS (SELECT s.*, a.kind, a.scale, a.st, least(a.st + a.mins, n) - a.st AS len, s.pos - a.st AS k, a.mult, a.lag,
            coalesce(s.pos >= a.st AND s.pos < least(a.st + a.mins, n) AND (a.kind = 'amplitude' OR s.unit = a.au), false) AS hit
          FROM (SELECT *, count(*) OVER (PARTITION BY container_id, unit) AS n FROM s{k - 1}) s LEFT JOIN {a} a ON s.container_id = a.container_id)""")
        ctes.append(f"""y{k} AS (SELECT *, CASE WHEN hit AND kind = 'lag' AND st >= lag THEN (pos - lag)::DOUBLE
            WHEN hit AND kind = 'frequency' THEN st + CASE WHEN m = 1 THEN 0 ELSE (CASE WHEN m >= len THEN k ELSE k % m END) * (len - 1) / (m - 1)::DOUBLE END END AS x
          FROM (SELECT *, CAST(trunc(len / mult) AS BIGINT) AS m FROM x{k}))""")
        ctes.append(f"""s{k} AS (SELECT y.container_id, y.unit, y.pos,
            CASE WHEN hit AND kind = 'amplitude' THEN 50 + (y.TmpRet - 50) * scale WHEN x IS NULL THEN y.TmpRet WHEN x = floor(x) THEN a.TmpRet ELSE a.TmpRet + (x - floor(x)) * (b.TmpRet - a.TmpRet) END AS TmpRet,
            y.anomaly OR hit AS anomaly, CASE WHEN hit THEN kind ELSE y.anomaly_type END AS anomaly_type
          FROM y{k} y LEFT JOIN s{k - 1} a ON y.container_id = a.container_id AND y.unit = a.unit AND a.pos = CAST(floor(x) AS BIGINT)
          LEFT JOIN s{k - 1} b ON y.container_id = b.container_id AND y.unit = b.unit AND b.pos = CAST(floor(x) AS BIGINT) + 1)""")
    return f"WITH {', '.join(ctes)} SELECT container_id, unit, pos, round(TmpRet, 6) AS TmpRet, anomaly, anomaly_type FROM s{len(steps)}"


DAY_SCORES = f"""(
  SELECT f.container_id, CAST(CAST(f.timestamp_et AS DATE) AS VARCHAR) AS day,
         max(CASE unit WHEN 0 THEN CASE WHEN dist_1 IS NOT NULL AND dist_2 IS NOT NULL THEN least(dist_1, dist_2) END WHEN 1 THEN CASE WHEN dist_0 IS NOT NULL AND dist_2 IS NOT NULL THEN least(dist_0, dist_2) END
             ELSE CASE WHEN dist_0 IS NOT NULL AND dist_1 IS NOT NULL THEN least(dist_0, dist_1) END END) AS anomaly_score, max(e) AS label
  FROM {flags("mad", 1, GAPPY, GAPPY_SMOOTH, GAPPY_DISTANCE)} f
  JOIN (SELECT user_id % 4 AS container_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS e FROM events GROUP BY ALL) t
    ON f.container_id = t.container_id AND CAST(f.timestamp_et AS DATE) = t.day
  GROUP BY ALL HAVING max(CASE unit WHEN 0 THEN CASE WHEN dist_1 IS NOT NULL AND dist_2 IS NOT NULL THEN 1 END WHEN 1 THEN CASE WHEN dist_0 IS NOT NULL AND dist_2 IS NOT NULL THEN 1 END ELSE CASE WHEN dist_0 IS NOT NULL AND dist_1 IS NOT NULL THEN 1 END END) = 1)"""

DOCUMENTS = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def metrics(source: str, score: str, label: str, by: str = "") -> str:
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""(SELECT {keys}sum(p * tp / (fetched * nullif(all_p, 0))) AS auc_pr, CASE WHEN max(all_p) * max(all_n - all_p) > 0 THEN sum(p * (below - pbelow + (n - p) / 2.0)) / (max(all_p) * max(all_n - all_p)) END AS auc_roc, max(all_p)::BIGINT AS positives, max(all_n - all_p)::BIGINT AS negatives
      FROM (SELECT {keys}p, n, sum(p) OVER (PARTITION BY {by or "1"} ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY {by or "1"} ORDER BY s DESC) AS fetched,
                   sum(n) OVER (PARTITION BY {by or "1"} ORDER BY s) - n AS below, sum(p) OVER (PARTITION BY {by or "1"} ORDER BY s) - p AS pbelow,
                   sum(p) OVER ({part}) AS all_p, sum(n) OVER ({part}) AS all_n
            FROM (SELECT {keys}{score} AS s, sum({label}) AS p, count(*) AS n FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {keys}{score})) {f"GROUP BY {by}" if by else ""})"""


STRATA = "(" + " UNION ALL ".join(f"SELECT '{c}' AS stratum, coalesce({c}, 'none') AS value, n_chars, toxic FROM {DOCUMENTS}" for c in ("lang", "source")) + ")"
EVENTS = f"""(SELECT user_id % 4 AS container_id, event_id % 3 AS unit, ts AS timestamp_et, value AS TmpRet, anomaly_type, anomaly_type <> 'normal' AS anomaly
  FROM (SELECT *, CASE event_type {" ".join(f"WHEN '{e}' THEN '{k}'" for e, k in EVENT_TYPES.items())} ELSE 'normal' END AS anomaly_type FROM events))"""


def plot(kind: str) -> str:
    own = f"(SELECT e.* FROM {EVENTS} e WHERE container_id IN (SELECT DISTINCT container_id FROM {EVENTS} WHERE anomaly_type = '{kind}' ORDER BY 1 LIMIT 2))"
    lines = f"SELECT container_id, 'unit ' || unit AS trace, 'line' AS kind, 'y' AS axis, timestamp_et AS x, TmpRet AS y, anomaly FROM {own}"
    if kind in ("lag", "frequency"):
        marks = f"SELECT container_id, 'anomaly of unit ' || unit, 'marker', 'y2', timestamp_et, 1.0, anomaly FROM {own} WHERE anomaly"
    else:
        marks = f"SELECT container_id, 'anomaly', 'marker', 'y2', timestamp_et, CASE WHEN anomaly THEN 1.0 ELSE 0.0 END, anomaly FROM {own}"
    return f"SELECT container_id, trace, kind, axis, x, round(y::DOUBLE, 6) AS y, bool_or(anomaly) OVER (PARTITION BY container_id, trace) AS has_anomaly FROM ({lines} UNION ALL {marks})"


_UNIT_DAYS = values([(c, u, k, d * 24 + h, hrs) for name in ("sequence", "lag") for c, _, u, k, d, h, hrs, *_ in ANOMALIES[name]], "container_id, unit, kind, st, hrs")
UNIT_DAYS = f"""
SELECT DISTINCT container_id::BIGINT AS container_id, unit::BIGINT AS unit, CAST(CAST(DATE '2024-01-01' + CAST(day AS INTEGER) AS DATE) AS VARCHAR) AS day, kind AS anomaly_type FROM (
  SELECT container_id, unnest(CASE WHEN kind = 'amplitude' THEN [0, 1, 2] ELSE [unit] END) AS unit, kind, st, hrs FROM {_UNIT_DAYS}) a,
  (SELECT unnest(range(0, 2)) AS day) WHERE day >= st // 24 AND day * 24 < st + hrs"""

TRUTH = f"""
SELECT l.container_id, timestamp_et, pair, round(distance, 6) AS distance, t.container_id IS NOT NULL AS truth FROM {long()} l
LEFT JOIN {values([(0, "2024-01-01"), (1, "2024-01-01")], "container_id, day")} t ON l.container_id = t.container_id AND CAST(timestamp_et AS DATE) = CAST(t.day AS DATE)"""

LEAD_TIMES = f"""(SELECT 'lead_time' AS stratum, CASE WHEN doc_id % 10 = 9 THEN 'none' WHEN doc_id % 10 < 1 THEN 'under 1 day' WHEN doc_id % 10 < 7 THEN '1 to 7 days' ELSE '7 days or more' END AS value, n_chars, toxic FROM {DOCUMENTS})"""
#: container, unit, rows of each type, whether any row is anomalous; container 0 is drawn.
MIXED_ROWS = [(0, u, 0, 0, 0, None) for u in range(3)] + [(1, u, 300 * (u == 2), 0, 0, u == 2) for u in range(3)] + [(2, u, 0, 0, 0, False) for u in range(3)] + [(3, u, 0, 180, 120 * (u == 1), True) for u in range(3)]
SCORED = f"""(SELECT *, CASE unit WHEN 0 THEN CASE WHEN dist_1 IS NOT NULL AND dist_2 IS NOT NULL THEN least(dist_1, dist_2) END WHEN 1 THEN CASE WHEN dist_0 IS NOT NULL AND dist_2 IS NOT NULL THEN least(dist_0, dist_2) END
  ELSE CASE WHEN dist_0 IS NOT NULL AND dist_1 IS NOT NULL THEN least(dist_0, dist_1) END END AS score FROM {flags("mad", 1)})"""

# squaring the covariance, its trace kept at 1, leads to the projection on the first principal component
PCA = f"""
WITH RECURSIVE m AS (SELECT * FROM (SELECT container_id, timestamp_et, {", ".join(f"avg(TmpRet) FILTER (unit = {u}) AS u{u}" for u in range(3))} FROM {DENSE} GROUP BY ALL) WHERE u0 + u1 + u2 IS NOT NULL),
means AS (SELECT avg(u0) AS m0, avg(u1) AS m1, avg(u2) AS m2 FROM m),
it AS (
  SELECT 0 AS k, covar_pop(u0, u0) / t AS a, covar_pop(u0, u1) / t AS b, covar_pop(u0, u2) / t AS c, covar_pop(u1, u1) / t AS d, covar_pop(u1, u2) / t AS e, covar_pop(u2, u2) / t AS f
  FROM m, (SELECT var_pop(u0) + var_pop(u1) + var_pop(u2) AS t FROM m) GROUP BY t
  UNION ALL
  SELECT k + 1, (a * a + b * b + c * c) / t, (a * b + b * d + c * e) / t, (a * c + b * e + c * f) / t, (b * b + d * d + e * e) / t, (b * c + d * e + e * f) / t, (c * c + e * e + f * f) / t
  FROM (SELECT *, a * a + d * d + f * f + 2 * (b * b + c * c + e * e) AS t FROM it WHERE k < 60)),
p AS (SELECT * FROM it WHERE k = 60)
SELECT container_id, timestamp_et, round(greatest(x * x + y * y + z * z - (a * x * x + d * y * y + f * z * z + 2 * (b * x * y + c * x * z + e * y * z)), 0), 6) AS score
FROM (SELECT container_id, timestamp_et, u0 - m0 AS x, u1 - m1 AS y, u2 - m2 AS z FROM m, means), p"""

ORACLES: dict[str, str] = {
    "rolling_mean_smooth": rounded("container_id, timestamp_et, unit", "TmpRet, TmpRet_smooth", smooth(DENSE, SMOOTH)),
    "rolling_distance": f"""
      SELECT container_id, timestamp_et, round(CASE WHEN count(d) OVER w = {DISTANCE} THEN sqrt(sum(d * d) OVER w) END, 6) AS distance FROM (
        SELECT container_id, timestamp_et, a.TmpRet - b.TmpRet AS d FROM (SELECT * FROM {DENSE} WHERE unit = 0) a FULL JOIN (SELECT * FROM {DENSE} WHERE unit = 1) b USING (container_id, timestamp_et))
      WINDOW w AS (PARTITION BY container_id ORDER BY timestamp_et ROWS {DISTANCE - 1} PRECEDING)""",
    "pivot_units": rounded("container_id, timestamp_et", "u0, u1, u2", pivot(DENSE, SMOOTH)),
    "pairwise_distances": rounded("container_id, timestamp_et, pair", "distance", long()),
    "pairwise_distances_gappy": rounded("container_id, timestamp_et, pair", "distance", long(GAPPY, GAPPY_SMOOTH, GAPPY_DISTANCE)),
    "threshold_mad": rounded("container_id, strategy", "threshold", limits("mad", 3)),
    "threshold_iqr": rounded("container_id, strategy", "threshold", limits("iqr", 1.5)),
    "threshold_mean_std": rounded("container_id, strategy", "threshold", limits("mean_std", 3)),
    "flag_units_mad": flags_query("mad", 1),
    "flag_units_mad_of_long": flags_query("mad", 1),
    "flag_units_iqr": flags_query("iqr", 0),
    "flag_units_default_k": flags_query("mad", 3),
    "flag_units_gappy": flags_query("mad", 1, GAPPY, GAPPY_SMOOTH, GAPPY_DISTANCE),
    "pairwise_distances_chunked": rounded("container_id, timestamp_et, pair", "distance", long()),
    "flag_units_chunked": flags_query("mad", 1),
    "flag_units_gappy_chunked": flags_query("mad", 1, GAPPY, GAPPY_SMOOTH, GAPPY_DISTANCE),
    "flag_counts": f"SELECT container_id, unit, count(*)::BIGINT AS rows, sum(anomaly_flag::INTEGER)::BIGINT AS flagged FROM {flags('mad', 1)} GROUP BY ALL",
    "charge_pattern": f"SELECT container_id::BIGINT AS container_id, unit::BIGINT AS unit, pos::INTEGER AS pos, round(pattern, 6) AS pattern FROM {CHARGE}",
    "normal_unit": NORMAL,
    **{f"inject_{name}": injected(name) for name in ANOMALIES},
    "day_scores": rounded("container_id, day, label", "anomaly_score", DAY_SCORES),
    "unit_day_labels": UNIT_DAYS,
    "event_metrics": rounded("positives, negatives", "auc_pr, auc_roc", metrics(DAY_SCORES, "anomaly_score", "label")),
    "event_auc_pr": rounded("positives, negatives", "auc_pr", metrics(DOCUMENTS, "n_chars", "toxic")),
    "event_auc_roc": rounded("positives, negatives", "auc_roc", metrics(DOCUMENTS, "n_chars", "toxic")),
    "metric_breakdown": rounded("stratum, value, positives, negatives", "auc_pr, auc_roc", metrics(STRATA, "n_chars", "toxic", "stratum, value")),
    "label_distribution": "SELECT 'quality' AS \"column\", quality::VARCHAR AS value, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY toxic",
    "type_distribution": f"""SELECT anomaly_type, unit_days, round_even(100.0::DOUBLE * unit_days / sum(unit_days) OVER (), 2)::DOUBLE AS percentage FROM (
      SELECT anomaly_type, count(DISTINCT container_id || '_' || unit || '_' || CAST(timestamp_et AS DATE)) AS unit_days FROM {EVENTS} GROUP BY 1)""",
    "type_counts": f"SELECT anomaly_type, count(*) AS n FROM {EVENTS} WHERE anomaly GROUP BY 1",
    "anomaly_rate": f"SELECT count(*) AS rows, sum(anomaly::INTEGER)::BIGINT AS anomalies, round(avg(anomaly::INTEGER) * 100, 6) AS percentage, count(DISTINCT container_id) AS containers FROM {EVENTS}",
    "plot_series": plot("amplitude"),
    "plot_markers": plot("lag"),
    "distances_with_truth": TRUTH,
    "zscore_baseline": f"""SELECT container_id, timestamp_et, unit, round(TmpRet, 6) AS TmpRet, round(z, 6) AS score, coalesce(z > 1.5, false) AS flagged
      FROM (SELECT *, abs(TmpRet - avg(TmpRet) OVER w) / nullif(stddev(TmpRet) OVER w, 0) AS z FROM {DENSE} WINDOW w AS (PARTITION BY container_id, unit))""",
    "load_dataset": f"SELECT * FROM {DOCUMENTS}",
    "generated_fleet_mixed": f"SELECT container_id::BIGINT AS container_id, unit::BIGINT AS unit, 5760::BIGINT AS rows, lag_rows::BIGINT AS lag_rows, amplitude_rows::BIGINT AS amplitude_rows, frequency_rows::BIGINT AS frequency_rows, any_anomaly::BOOLEAN AS any_anomaly FROM {values(MIXED_ROWS, 'container_id, unit, lag_rows, amplitude_rows, frequency_rows, any_anomaly')}",
    "generated_fleet_shape": "SELECT c AS container_id, u AS unit, 4320::BIGINT AS rows, 4320::BIGINT AS times, '2024-01-01 00:00:00' AS first, '2024-01-03 23:59:00' AS last, 0::BIGINT AS outside, 0::BIGINT AS anomalies FROM range(5) a(c), range(3) b(u)",
    "cycle_shape": "SELECT 50::BIGINT AS containers, 500::BIGINT AS days, 0::BIGINT AS too_many, 0::BIGINT AS short, 0::BIGINT AS late, 0::BIGINT AS odd_peaks, 0::BIGINT AS odd_baselines",
    "random_scorer_shape": "SELECT count(*) AS n, 0::BIGINT AS outside, true AS centred FROM documents",
    "results_table_shape": f"SELECT method, positives, negatives, 1::BIGINT AS within FROM {metrics(DAY_SCORES, 'anomaly_score', 'label')}, (VALUES ('distance'), ('random')) AS m(method)",
    "unit_day_share": f"""SELECT anomaly_type, count(*) AS unit_days, round_even(100.0::DOUBLE * count(*) / any_value(n), 2)::DOUBLE AS percentage FROM (
      SELECT DISTINCT anomaly_type, container_id, unit, CAST(timestamp_et AS DATE) AS day FROM {EVENTS} WHERE anomaly), (SELECT count(*) AS n FROM (SELECT DISTINCT container_id, unit, CAST(timestamp_et AS DATE) FROM {EVENTS})) GROUP BY 1""",
    "breakdown_by_lead_time": rounded("stratum, value, positives, negatives", "auc_pr, auc_roc", metrics(LEAD_TIMES, "n_chars", "toxic", "stratum, value")),
    "stratified_sample": f"SELECT lang, toxic, least(count(*), 25) AS n, least(count(*), 25) AS different FROM {DOCUMENTS} GROUP BY lang, toxic",
    "score_overlay": f"SELECT container_id, 'unit ' || unit AS trace, 'y' AS axis, timestamp_et AS x, round(TmpRet, 6) AS y FROM {DENSE} UNION ALL SELECT container_id, 'score of unit ' || unit, 'y2', timestamp_et, round(score, 6) FROM {SCORED}",
    "flagged_series": f"SELECT s.container_id, s.unit, s.timestamp_et, round(s.TmpRet, 6) AS TmpRet, f.unit IS NOT NULL AS flagged FROM {DENSE} s LEFT JOIN (SELECT container_id, unit, timestamp_et FROM {flags('mad', 1)} WHERE anomaly_flag) f ON s.container_id = f.container_id AND s.unit = f.unit AND s.timestamp_et = f.timestamp_et",
    "grouped_bars": f"SELECT \"group\", metric, round(value, 6) AS value FROM (SELECT value AS \"group\", 'auc_pr' AS metric, auc_pr AS value FROM {metrics(STRATA, 'n_chars', 'toxic', 'stratum, value')} WHERE stratum = 'lang' UNION ALL SELECT value, 'auc_roc', auc_roc FROM {metrics(STRATA, 'n_chars', 'toxic', 'stratum, value')} WHERE stratum = 'lang') WHERE value IS NOT NULL",
    "missing_distances": f"SELECT container_id, pair, count(*) AS n, count(*) FILTER (distance IS NULL) AS missing FROM {long(GAPPY, GAPPY_SMOOTH, GAPPY_DISTANCE)} GROUP BY ALL",
    "self_distances": f"SELECT unit, bool_and(CASE unit WHEN 0 THEN dist_0 WHEN 1 THEN dist_1 ELSE dist_2 END = 0) AS all_zero, count(CASE unit WHEN 0 THEN dist_0 WHEN 1 THEN dist_1 ELSE dist_2 END) AS n FROM {flags('mad', 1)} GROUP BY unit",
    "first_rows": f"SELECT container_id, timestamp_et, unit, TmpRet FROM {DENSE} ORDER BY timestamp_et, unit, container_id LIMIT 25",
    "csv_round_trip": rounded("container_id, timestamp_et, unit", "TmpRet", DENSE),
    "pca_error": PCA,
}
