"""URL filters: host and path rules applied by a sort-merge range join.

A url's key is its host with the labels reversed and a closing dot (``a.example.com`` is ``com.example.a.``), so that a
rule's host, itself and all subdomains, is one interval of keys: those that start with the rule's key. Urls and rules
are dealt to key ranges, sorted, and swept once per range. The sweep keeps a stack of the rules whose interval is open;
reversed hosts nest like brackets, so the stack holds one entry a label at most. Of the open rules, those whose path the
url's path starts with fit, and the longest wins.

Ranges are cut at quantiles of a bounded sample of (key, hash) pairs; the sample moves only the cuts, never a verdict.
The hash spreads a host with a large share of all urls over many ranges, and a rule goes to every range that its
interval meets.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.shared import ascii_lower, hash_sample, table

#: Of the contract: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
#: (key, hash) pairs that the cuts between ranges are taken from, for each range.
SAMPLE_PER_RANGE = 40
#: The host (after the first "://"), then the path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ranges(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """n - 1 cuts at most, from a bounded sample in hash order."""
    sample = sorted((r["key"].encode(), r["salt"]) for r in hash_sample(keyed.select("key", "salt"), F.col("salt"), n * SAMPLE_PER_RANGE).collect())
    # salts of a sample in hash order are all small: within a key they are replaced by even steps over the hash's range
    cuts, size = [], max(1, len(sample) // n)
    for i in range(size, len(sample), size):
        key = sample[i][0]
        first, last = bisect.bisect_left(sample, (key, -(1 << 63))), bisect.bisect_right(sample, (key, 1 << 63))
        cuts.append((key, -(1 << 63) + ((i - first) * ((1 << 64) - 1)) // max(1, last - first)))
    return sorted(set(cuts))[: n - 1]


def _rules_in_ranges(cuts: list[tuple[bytes, int]]):
    def run(batches):
        for batch in batches:
            rows = []
            for key, path, name, verdict in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low, high = bisect.bisect_left(cuts, (key.encode(), -(1 << 63))), bisect.bisect_right(cuts, (key.encode() + b"\xff", 1 << 63))
                rows += [(r, key, 0, 0, path, name, verdict) for r in range(low, high + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("range", "key", "kind", "salt", "path", "rule", "verdict"), x, strict=True)) for x in rows], schema=_SIDE)

    return run


_SIDE = pa.schema([("range", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("salt", pa.int64()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def _range_of(cuts: list[tuple[bytes, int]]):
    def run(batches):
        for batch in batches:
            found = [bisect.bisect_right(cuts, (k.encode(), s)) for k, s in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    return run


def _sweep(default: str):
    def run(batches):
        at, stack = None, []
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "rule", "verdict")}
            keep, rules, verdicts = [], [], []
            for i, (where, key, kind, path, rule, verdict) in enumerate(zip(*columns.values(), strict=True)):
                if where != at:
                    at, stack = where, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, rule, verdict))
                    continue
                best = None
                for _, own in reversed(stack):
                    fits = [x for x in own if path.startswith(x[0])]
                    if fits:
                        best = max(fits, key=lambda x: (len(x[0]), x[2] == "block", x[1]))
                        break
                keep.append(i)
                rules.append(best and best[1])
                verdicts.append(best[2] if best else default)
            urls = batch.take(pa.array(keep, pa.int64()))
            rest = [c for c in batch.schema.names if c not in ("range", "key", "kind", "salt", "rule", "verdict")]
            yield pa.RecordBatch.from_arrays([*(urls.column(c) for c in rest), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], [*rest, "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row of pages: the id, host, path, rule (host and path of the rule that won, or null) and verdict.

    rules: host, path, verdict. The longest rule that fits wins: the one with the most host, then with the most path;
    of two verdicts for one host and path, block. Null urls and urls without ``://`` have an empty host and path and
    get the default unless a rule fits those. Rows that repeat are judged each; a null id stays null. No rules: the
    default for all. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_column).cast("string")
    urls = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = urls.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("id", "host", "path"))
    cuts = _ranges(keyed, n)
    id_type = keyed.schema["id"].dataType.simpleString()
    dealt = keyed.mapInArrow(_range_of(cuts), f"range int, id {id_type}, host string, path string, key string, salt long")
    name = F.concat("host", "path")
    intervals = (
        rules.where("host is not null and path is not null and verdict is not null").dropDuplicates(["host", "path", "verdict"])
        .select(host_key(ascii_lower(F.col("host"))).alias("key"), "path", name.alias("rule"), "verdict")
        .mapInArrow(_rules_in_ranges(cuts), "range int, key string, kind int, salt long, path string, rule string, verdict string")
    )
    both = dealt.withColumns({"kind": F.lit(1), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).unionByName(intervals, allowMissingColumns=True)
    swept = both.repartition(n, "range").sortWithinPartitions("range", "key", "kind", "salt")
    return (
        swept.select("range", "key", "kind", "salt", "rule", "verdict", "id", "host", "path")
        .mapInArrow(_sweep(default), f"id {id_type}, host string, path string, rule string, verdict string")
        .withColumnRenamed("id", id_column)
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = " OR ".join(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in RULES)
_BY_LENGTH = sorted(RULES, key=lambda x: (-x[0].count("."), -len(x[1])))


def _case(value: int | None) -> str:
    arms = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value is None else v}'" for h, p, v in _BY_LENGTH)
    return f"CASE {arms} ELSE {'NULL' if value is None else repr(DEFAULT_VERDICT)} END"


ORACLE = rf"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, {_case(None)} AS rule, {_case(1)} AS verdict FROM parsed
"""

QUERIES, ORACLES = {"op3_url_filters": op3_url_filters}, {"op3_url_filters": ORACLE}
