"""Quality rules: fixed floors, then adaptive thresholds per language and source from mergeable quantile sketches.

The sketch is a relative-error quantile sketch: a value v >= 1 falls into bucket ceil(ln v / ln GAMMA), smaller ones into
bucket 0, and a sketch is the map of buckets to counts. Two sketches merge by adding counts, so that a sketch is a
``groupBy(..., bucket).count()`` with partial aggregation on the map side: exact merges, the same result in any order,
and at most a few hundred buckets a group whatever its size. A quantile read from it is off by under 1 % of its value.

Three sketches a document's group are read, for the shape of a text:

* symbols: 1000 * n_symbols / word_chars
* repeats: 1000 * n_repeat_words / n_words
* length: 100 * word_chars / n_words, the mean word's length

A text is rejected when a value lies above its group's fence q75 + REACH * (q75 - q25), where the spread is at least
LEAST_SPREAD of the scale; for the length, below the fence on the other side as well. The quantiles come from the texts
that pass the fixed floors. A group of fewer than LEAST_GROUP such texts takes its language's sketch, and a small
language that of all: those are sums of the same buckets.

The words of a text are handled in one array expression per row; nothing but (doc_id, counts) is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.shared import broadcast_if_small, fresh, table, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: 1 % relative error: (1 + a) / (1 - a) with a = 0.01.
GAMMA = 1.01 / 0.99
REACH, LEAST_GROUP = 3.0, 50
#: measure: the value's SQL, the least spread of q75 - q25, whether low values are outliers too.
MEASURES = {
    "symbols": ("floor(1000 * n_symbols / greatest(word_chars, 1))", 20.0, False),
    "repeats": ("floor(1000 * n_repeat_words / greatest(n_words, 1))", 120.0, False),
    "length": ("floor(100 * word_chars / greatest(n_words, 1))", 60.0, True),
}
#: Group rows (languages times sources) that are broadcast to the documents; beyond that Spark joins by a shuffle.
BROADCAST_GROUPS = 100_000
#: Rejected texts whose keys are broadcast to the documents, 16 bytes each.
BROADCAST_REJECTED = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs' columns without the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; null texts count as empty.

    n_repeat_words: 3-word windows are sorted by their words; neighbours that agree are windows found twice or more,
    and the positions that they cover are counted once.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c != text_column]
    a = docs.select(*keep, text.alias("_t"))
    a = a.withColumns({"_w": words_of(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_w")
    windows = F.when(n < 3, F.array().cast("array<struct<a:string,b:string,c:string,i:int>>")).otherwise(
        F.sort_array(F.arrays_zip(F.slice("_w", 1, F.greatest(n - 2, F.lit(1))).alias("a"), F.slice("_w", 2, F.greatest(n - 2, F.lit(1))).alias("b"), F.slice("_w", 3, F.greatest(n - 2, F.lit(1))).alias("c"), F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))).alias("i")))
    )
    a = a.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_s"),
    )
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    found = F.filter("_s", lambda x, j: F.coalesce(same(x, F.get("_s", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", j + 1)), F.lit(False)))
    at = F.transform(found, lambda x: x["i"])
    a = a.withColumn("_p", at).drop("_s")
    covered = F.array_distinct(F.concat("_p", F.transform("_p", lambda i: i + 1), F.transform("_p", lambda i: i + 2)))
    return a.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def _bucket(value: str) -> str:
    return f"cast(CASE WHEN {value} < 1 THEN 0 ELSE ceil(ln(cast({value} AS double)) / ln({GAMMA!r}D)) + 1 END AS int)"


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over rows that pass the fixed floors."""
    stacked = counted.where("NOT base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {', '.join(f"'{m}', {_bucket(v)}" for m, (v, _, _) in MEASURES.items())}) AS (measure, bucket)")
    return stacked.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) of every group in the sketch, by merging to wider groups where a group is small."""
    spark = sketch.sparkSession
    # one pass reads the quantiles of the three levels; a missing lang or source is a group of its own
    levels = {"own": "lang, source", "language": "lang", "all": ""}
    parts = []
    for level, by in levels.items():
        keys = f"{by}, " if by else ""
        parts.append(f"""
          SELECT '{level}' AS level, {'lang' if by else 'CAST(NULL AS STRING)'} AS lang, {'source' if 'source' in by else 'CAST(NULL AS STRING)'} AS source, measure, max(total) AS total,
                 min(CASE WHEN 4 * upto >= total THEN value END) AS q25, min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q75
          FROM (SELECT {keys}measure, CASE WHEN bucket = 0 THEN 0D ELSE 2 * pow({GAMMA!r}D, bucket - 1) / ({GAMMA!r}D + 1) END AS value,
                       sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
                FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM {{sketch}} GROUP BY {keys}measure, bucket))
          GROUP BY {keys}measure""")
    q = spark.sql(" UNION ALL ".join(parts), sketch=sketch)
    own, lang, every = (q.where(F.col("level") == level) for level in levels)
    pick = lambda c: F.when(F.col("o.total") >= LEAST_GROUP, F.col(f"o.{c}")).when(F.col("l.total") >= LEAST_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    joined = (
        own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
        .join(every.alias("e"), F.col("o.measure") == F.col("e.measure"))
        .select("o.lang", "o.source", "o.measure", pick("q25").alias("q25"), pick("q75").alias("q75"))
    )
    least = F.create_map(*(F.lit(x) for m, (_, s, _) in MEASURES.items() for x in (m, s)))
    spread = REACH * F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")])
    ends = joined.withColumns({"low": F.col("q25") - spread, "high": F.col("q75") + spread})
    return ends.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(end))).alias(f"{m}_{end}") for m in MEASURES for end in ("low", "high")))


def judge(docs: DataFrame, *ids: str) -> DataFrame:
    """A row per row of docs: the ids (doc_id unless named), lang, source, the five counts, base_failed and kept.

    Every row is judged on its own, rows that repeat or have a null doc_id too. A null text has no words and fails the
    floor; a null lang or source is a group of its own. An empty table gives an empty result. Only the ids, text, lang
    and source are read.
    """
    docs = docs.select(*(ids or ("doc_id",)), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # a few numbers a text: dealt anew, they take few files, and an executor starts up to three processes for each
    counted = written(with_counts(docs).withColumn("base_failed", base).hint("rebalance"), "quality-counts")
    ends = broadcast_if_small(written(fences(written(sketches(counted), "quality-sketches")), "quality-fences"), BROADCAST_GROUPS)
    ends = ends.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = []
    for m, (value, _, low) in MEASURES.items():
        v = F.expr(value)
        out.append(v > F.col(f"{m}_high"))
        if low:
            out.append(v < F.col(f"{m}_low"))
    rejected = F.lit(False)
    for x in out:
        rejected = rejected | F.coalesce(x, F.lit(False))
    joined = counted.join(ends, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(*counted.columns, (~F.col("base_failed") & ~rejected).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """docs' rows and columns without those that judge() rejects."""
    key = lambda salt: F.xxhash64("doc_id", "text", "lang", "source", F.lit(salt))
    k1, k2 = fresh(docs, "_k1", "_k2")
    judged = judge(docs.select(key(1).alias(k1), key(2).alias(k2), "lang", "source", "text"), k1, k2)
    gone = broadcast_if_small(written(judged.where("NOT kept").select(k1, k2).distinct(), "quality-gone"), BROADCAST_REJECTED)
    return docs.join(gone, (key(1) == F.col(k1)) & (key(2) == F.col(k2)), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    values = {m: f"CAST({v.replace('floor(', '(').replace(' / ', ' // ')} AS DOUBLE)" for m, (v, _, _) in MEASURES.items()}
    bucket = lambda v: f"CASE WHEN {v} < 1 THEN 0 ELSE CAST(ceil(ln({v}) / ln({GAMMA!r})) + 1 AS INTEGER) END"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bucket(v)} AS bucket FROM counted WHERE NOT base_failed" for m, v in values.items())
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s!r}" for m, (_, s, _) in MEASURES.items()) + " END"

    def level(keys: str) -> str:
        return f"""SELECT {keys}measure, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN value END) AS q25, min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q75
          FROM (SELECT {keys}measure, CASE WHEN bucket = 0 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket - 1) / ({GAMMA!r} + 1) END AS value,
                       sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
                FROM (SELECT {keys}measure, bucket, count(*) AS n FROM stacked GROUP BY {keys}measure, bucket))
          GROUP BY {keys}measure"""

    pick = lambda c: f"CASE WHEN o.total >= {LEAST_GROUP} THEN o.{c} WHEN l.total >= {LEAST_GROUP} THEN l.{c} ELSE e.{c} END"
    bad = " OR ".join(f"coalesce({v} > q75 + {REACH} * greatest(q75 - q25, {MEASURES[m][1]}) {f'OR {v} < q25 - {REACH} * greatest(q75 - q25, {MEASURES[m][1]})' if MEASURES[m][2] else ''}, false) AND measure = '{m}'" for m, v in values.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
counted AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
  SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r))),
stacked AS ({stacked}),
o AS ({level('lang, source, ')}), l AS ({level('lang, ')}), e AS ({level('')}),
ends AS (SELECT o.lang, o.source, o.measure, {pick('q25')} AS q25, {pick('q75')} AS q75
         FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN e ON o.measure = e.measure),
bad AS (SELECT DISTINCT r FROM counted JOIN ends ON counted.lang IS NOT DISTINCT FROM ends.lang AND counted.source IS NOT DISTINCT FROM ends.source WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM counted
"""


ORACLE = _oracle()
QUERIES, ORACLES = {"op5_quality_rules": op5_quality_rules}, {"op5_quality_rules": ORACLE}
