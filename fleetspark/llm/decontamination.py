"""Benchmark decontamination: windows of ten words of test items, looked up in every document.

Both sides are normalised alike: A-Z lower-cased, words are runs of ASCII letters and digits and of all other non-ASCII
characters. The items' windows, a table whose size is checked first, are broadcast as a hash table; every window of every
document is probed against it and verified word by word, as the key is the window's text itself. Only hits, and one row
a document for its count of words, are shuffled. A benchmark beyond the checked size is joined by a shuffle instead.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetspark.llm.shared import ascii_lower, broadcast_if_small, each_row, fresh, table, written

WINDOW = 10
#: Separators of words, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of test items that are broadcast, and bytes of these with all their items' ids.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Contaminated documents whose keys are broadcast to the documents.
BROADCAST_DOCUMENTS = 200_000

_NO_WINDOWS = "array<struct<pos:int,len:int,window:string>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _windows(words: str, size: Column, length: int) -> Column:
    made = F.transform(F.sequence(F.lit(0), F.greatest(size - length, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, length), " ").alias("window")))
    return F.when(size >= length, made).otherwise(F.array().cast(_NO_WINDOWS))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, window, items): every window of the items and the ids, as strings, of the items that hold it.

    An item of fewer words is one window; one without words, or null, has none. A null item_id is the empty string.
    """
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    b = b.select("item", F.explode(F.transform(at, lambda i: F.slice("w", i, window))).alias("g"))
    return b.groupBy(F.size("g").alias("len"), F.array_join("g", " ").alias("window")).agg(F.collect_set("item").alias("items"))


def _sized(items: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """The windows, their lengths (one to `window`), and whether they are few enough to broadcast.

    Few windows are made again from the benchmark where they are used: a table of theirs would be a small file for each
    partition of the shuffle, and Hadoop starts a process or two for each file. More are written, for their true size.
    """
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    found = items.agg(F.collect_set("len").alias("lengths"), F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    small = found["n"] <= BROADCAST_WINDOWS and (found["bytes"] or 0) <= BROADCAST_BYTES
    return items if small else written(items, "windows"), sorted(found["lengths"]), small


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, spans (array of start and end word positions that are
    hit), items (sorted ids, as strings, of the items with occurring windows).

    A null text has no words. Rows that repeat give a row each; a null doc_id stays null. An empty benchmark hits
    nothing, an empty table gives no rows. Other columns than doc_id and text are not read.
    """
    items, lengths, small = _sized(item_windows(benchmark, window))
    text = F.col("text").cast("string")
    d = docs.select("doc_id", text_key(text).alias("text_key"), words_of(text).alias("w"))
    d = d.select("doc_id", "text_key", "w", F.size("w").alias("n_words"))
    one = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("window")))
    d = d.select("doc_id", "text_key", "n_words", F.explode(F.concat(one, *(_windows("w", F.col("n_words"), n) for n in lengths))).alias("e"))
    d = d.select("doc_id", "text_key", "n_words", "e.pos", "e.len", "e.window")
    items = items.select("window", "items")
    found = d.join(F.broadcast(items) if small else items, "window", "left").where("items IS NOT NULL OR pos = -1").drop("window")
    # rows that repeat have the same hits: counted before they meet, so that they are no hot key
    found = found.groupBy("doc_id", "text_key", "n_words", "pos", "len", "items").agg(F.count("*").alias("rows"))
    by = Window.partitionBy("doc_id", "text_key")
    before = F.max(F.col("pos") + F.col("len")).over(by.orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("pos") > F.greatest(before, F.lit(0))) | (F.col("pos") >= 0) & (F.coalesce(before, F.lit(-1)) < 0)
    # a span is a run of hits that overlap or touch
    spans = found.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(by.orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "text_key", "span").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("pos") == -1, F.col("rows"))).alias("rows"),
        F.min(F.when(F.col("pos") >= 0, F.col("pos"))).alias("start"),
        F.max(F.when(F.col("pos") >= 0, F.col("pos") + F.col("len"))).alias("end"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    out = spans.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum("rows").alias("rows"),
    )
    return each_row(out, "rows")


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs' rows and columns without contamination.

    mode "documents" drops the documents with a hit; "spans" keeps them and cuts the hit words out of their texts, each
    with the separators that follow it (n_chars, where it is a column, follows the text). Clean rows stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"Unknown mode: {mode!r}")
    doc, key, spans, words, gaps, cut = fresh(docs, "_doc", "_key", "_spans", "_words", "_gaps", "_cut")
    hit = written(find(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([doc, key]), "contaminated")
    hit = broadcast_if_small(hit, BROADCAST_DOCUMENTS)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key(F.col("text").cast("string")) == F.col(key))
    if mode == "documents":
        return docs.join(hit.drop(spans), same, "left_anti")
    lower = ascii_lower(F.col("text"))
    # what stands before, between and after the words has as many characters in the text as in its lower-cased copy
    a = docs.join(hit, same, "left").drop(doc, key)
    a = a.withColumns({words: F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1)), gaps: F.split(lower, WORD, -1)})
    lengths = F.transform(words, lambda w, i: F.struct(F.length(w).alias("w"), F.length(F.get(gaps, i + 1)).alias("g")))
    a = a.withColumn(cut, F.aggregate(lengths, F.struct(F.lit(0).alias("i"), (F.length(F.get(gaps, F.lit(0))) + 1).alias("at"), F.substring("text", 1, 0).alias("out")), lambda acc, x: F.struct(
        (acc["i"] + 1).alias("i"), (acc["at"] + x["w"] + x["g"]).alias("at"),
        F.when(F.exists(spans, lambda s: (s["start"] <= acc["i"]) & (acc["i"] < s["end"])), acc["out"]).otherwise(F.concat(acc["out"], F.col("text").substr(acc["at"], x["w"] + x["g"]))).alias("out"))))
    rest = F.concat(F.substring("text", F.lit(1), F.length(F.get(gaps, F.lit(0)))), F.col(f"{cut}.out"))
    a = a.withColumn("text", F.when(F.col(spans).isNotNull(), rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        a = a.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return a.select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
dg AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, dg.i, dg.n, g.item_id FROM dg JOIN g ON dg.g = g.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

QUERIES, ORACLES = {"op4_decontamination": op4_decontamination}, {"op4_decontamination": ORACLE}
