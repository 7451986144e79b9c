"""Secret scans: candidates by pattern, then a random forest that removes false positives.

A candidate is a private key's block, a run of token characters with a digit in it, or whatever is assigned to a
credential's name. The forest sees the candidate's length and mix of characters, its character transitions (how often one
class of characters follows another, and how many neighbouring letters are no neighbours in common words), how much of
it common words cover, whether it is part of a path, and the words beside it. It is trained here from labelled findings:
FINDINGS describes kinds of secrets and of harmless look-alikes, and ``labelled_findings`` writes out a bounded number
of each with a label, the words around them included.

All of it is DataFrame functions and Spark's own machine learning; offsets come from the texts between candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetspark.llm.shared import broadcast_if_small, each_row, fresh, table, written

#: Characters of a token, and names that a credential is assigned to.
TOKEN = r"A-Za-z0-9+/_\-"
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer"
#: What stands before an assigned value. The two short look-behinds spare almost all positions the one for the name.
ASSIGNED = rf"(?<=[:= \"'])(?<=[:=][ ]{{0,2}}[\"']?)(?i:(?<=(?:{NAMES})[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?))"
#: A private key's block: its lines, and the one that ends it where there is one.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*+[A-Za-z0-9+/=]{16,}+)*+(?:\s*+[A-Za-z0-9+/=]++(?=\s*+-----END ))?+(?:\s*+-----END [A-Z ]*PRIVATE KEY-----)?+"
CANDIDATE = rf"{KEY_BLOCK}|{ASSIGNED}[^\s\"']{{6,}}|(?<![{TOKEN}])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{{10,}}+={{0,2}}"
#: Characters kept on either side of a candidate for the words beside it.
CONTEXT = 80
THRESHOLD, PLACEHOLDER = 0.5, "[SECRET]"
#: Labelled findings to train from, of each kind; trees of the forest and their depth.
FINDINGS_PER_KIND, TREES, DEPTH, SEED = 150, 24, 7, 17
#: Documents with secrets whose keys are broadcast to the documents.
BROADCAST_DOCUMENTS = 200_000

# Common words of English, German, French and Spanish, for dictionary coverage.
DICTIONARY = ("the and that this with from have will your about which their would there could other after first these into time only over also people because between under never again where while world house point page home file image data user name report version example default config index main test build release document article product order number date "
    "der die und das nicht mit sich auf ein eine auch werden aus hat dass sie nach wird bei einer noch wie einem über haben zum seite bild datei name jahr "
    "les des est une pour que qui dans par sur pas plus avec tout faire son mais comme nous vous leur page fichier image date nom année "
    "los las una por con para como más pero sus este entre cuando muy sin sobre ser tiene también hasta desde página archivo imagen fecha nombre año").split()
#: Pairs of letters that stand together in these words.
PAIRS = sorted({w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1)})
# Words beside harmless tokens.
HARMLESS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|id|order|invoice|phone|tel|fax|isbn|card|account|version|build|revision|rev|etag|hash|ticket|issue|part|serial|model|row|page|figure|call|number|no"

#: kind, label, the candidate's SQL, the text before it, the text after it; h, d and w make text from a seed.
FINDINGS = [
    ("cloud key", 1, "concat('AKIA', u(16))", "", ""),
    ("hex in quotes", 1, "h(40)", "token = \"", "\""),
    ("hex assigned", 1, "h(18)", "password=", ""),
    ("hex of 32", 1, "h(32)", "api_key: ", ""),
    ("mixed assigned", 1, "b(24)", "secret = '", "'"),
    ("mixed bearer", 1, "concat(b(40), '=')", "Authorization: Bearer ", ""),
    ("prefix", 1, "concat('ghp_', b(36))", "", ""),
    ("prefix live", 1, "concat('sk_live_', b(24))", "", ""),
    ("prefix chat", 1, "concat('xoxb-', d(12), '-', b(24))", "", ""),
    ("mixed alone", 1, "b(40)", "", ""),
    ("private key", 1, "concat('-----BEGIN PRIVATE KEY-----\\n', b(64), '\\n', b(48), '\\n-----END PRIVATE KEY-----')", "", ""),
    ("chosen word", 1, "concat(w(1), d(4), substr(b(3), 1, 3))", "password: ", ""),
    ("card", 0, "d(16)", "", ""),
    ("long number", 0, "d(12)", "order ", ""),
    ("phone", 0, "concat(d(3), '-', d(3), '-', d(4))", "call ", ""),
    ("date", 0, "concat('20', d(2), '-0', substr(d(1), 1, 1), '-1', substr(d(1), 1, 1), 'T10')", "on ", ""),
    ("uuid", 0, "concat(h(8), '-', h(4), '-', h(4), '-', h(4), '-', h(12))", "uuid ", ""),
    ("commit", 0, "h(40)", "commit ", ""),
    ("checksum", 0, "h(64)", "sha256 ", ""),
    ("md5", 0, "h(32)", "md5 ", ""),
    ("path", 0, "concat(w(1), '/', w(2), d(2), '/', w(3), '-', d(4))", "/", ".html"),
    ("asset", 0, "concat(w(1), '-', h(8))", "/static/", ".js"),
    ("slug", 0, "concat(w(1), '-', w(2), '-', w(3), '-', d(4))", "", ""),
    ("identifier", 0, "concat(w(1), '_', w(2), d(2))", "", ""),
    ("long word", 0, "concat(w(1), w(2), d(1))", "", ""),
    ("placeholder", 0, "concat('your_', w(1), '_here', d(1))", "password = ", ""),
    ("masked", 0, "'xxxxxxxxxxxx'", "token: ", ""),
    ("variable", 0, "concat('get_', w(1), '_', w(2), '()')", "secret = ", ""),
    ("version", 0, "concat('release-', d(1), '-', d(2), '-', d(3), '-build')", "version ", ""),
]

FEATURES = ["length", "digits", "uppers", "lowers", "marks", "transitions", "to_digit", "to_upper", "odd_pairs", "variety", "hexadecimal", "covered", "in_path", "named", "assigned", "quoted", "harmless", "prefixed", "prose"]


def with_features(c: DataFrame) -> DataFrame:
    """c (candidate, before, after) with FEATURES; empty candidates don't occur."""
    x, n = F.col("candidate"), F.length("candidate").cast("double")
    count = lambda kind: F.length(F.regexp_replace(x, f"[^{kind}]", ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^0-9A-Za-z]+", "-")
    # every two letters that are neighbours: from even and from odd places
    letters = F.concat(*(F.regexp_extract_all(F.lower(y), F.lit("[a-z]{2}"), F.lit(0)) for y in (x, F.regexp_replace(x, "(?<![A-Za-z])[A-Za-z]", ""))))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return c.withColumns(
        {
            "length": n,
            "digits": count("0-9") / n,
            "uppers": count("A-Z") / n,
            "lowers": count("a-z") / n,
            "marks": count("+/_=-") / n,
            "transitions": (F.length(kinds) - 1) / n,
            "to_digit": F.regexp_count(x, F.lit("[A-Za-z](?=[0-9])")) / n,
            "to_upper": F.regexp_count(x, F.lit("[a-z](?=[A-Z])")) / n,
            "odd_pairs": F.size(F.filter(letters, lambda p: ~F.array_contains(F.array(*map(F.lit, PAIRS)), p))) / F.greatest(F.size(letters), F.lit(1)),
            "variety": F.size(F.array_distinct(F.split(x, ""))) / n,
            "hexadecimal": flag(x.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "covered": 1 - F.length(F.regexp_replace(F.lower(x), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
            "in_path": flag(x.rlike("[^/]/[^/]+/") | F.col("before").rlike(r"[/\\.?&@]$") | F.col("after").rlike(r"^(/|\.[a-z])")),
            "named": flag(F.col("before").rlike(rf"(?i)(?:{NAMES})[\"']?\s{{0,2}}[:= ]\s{{0,2}}[\"']?$")),
            "assigned": flag(F.col("before").rlike(r"[:=]\s{0,2}[\"']?$")),
            "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "harmless": flag(F.col("before").rlike(rf"(?i)(?:^|[^a-z])(?:{HARMLESS})\W{{0,3}}$")),
            "prefixed": flag(x.rlike("^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|sk_|sk-|pk_live|rk_live|xox[abprs]-|eyJ)")),
            "prose": flag(F.col("before").rlike(r"[a-zA-Z,.;:!?]\s$") | (F.col("before") == "")),
        }
    )


def labelled_findings(spark: SparkSession, per_kind: int = FINDINGS_PER_KIND, offset: int = 0, kinds: list[tuple] = FINDINGS) -> DataFrame:
    """(kind, label, candidate, before, after): per_kind of each of the kinds, made from hashes of (kind, number)."""
    draws = {
        "h": "substr(concat(sha2(concat('h', {n}, s), 256), sha2(concat('g', {n}, s), 256)), 1, {n})",
        "d": "substr(translate(sha2(concat('d', {n}, s), 256), 'abcdef', '135792'), 1, {n})",
        "b": "substr(translate(base64(unhex(sha2(concat('b', {n}, s), 512))), '+/', 'aZ'), 1, {n})",
        "u": "substr(translate(upper(base64(unhex(sha2(concat('u', {n}, s), 512)))), '+/', 'Q7'), 1, {n})",
        "w": f"element_at(split('{' '.join(DICTIONARY)}', ' '), cast(1 + pmod(xxhash64(s, {{n}}), {len(DICTIONARY)}) AS int))",
    }
    import re

    parts = []
    words = "concat_ws(' ', {0}, {1}, {2})".format(*(draws["w"].replace("{n}", str(k)) for k in (7, 8, 9)))
    for number, (kind, label, sql, before, after) in enumerate(kinds):
        sql = re.sub(r"\b([hdbuw])\((\d+)\)", lambda m: draws[m[1]].replace("{n}", m[2]), sql)
        quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = spark.range(offset, offset + per_kind, 1, 1).selectExpr(f"concat('{number}-', id) AS s")
        parts.append(rows.selectExpr(f"{quote(kind)} AS kind", f"{label} AS label", f"{sql} AS candidate", f"concat({words}, ' ', {quote(before)}) AS before", f"concat({quote(after)}, ' ', {words}) AS after"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train(spark: SparkSession, per_kind: int = FINDINGS_PER_KIND, kinds: list[tuple] = FINDINGS) -> RandomForestClassificationModel:
    """The forest; per_kind bounds the findings it is trained from."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled_findings(spark, per_kind, kinds=kinds)).coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(data.select("features", "label"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, number, start, candidate, before, after): start counts characters from 0, number the text's candidates."""
    text = F.col("text").cast("string")
    d = docs.select("doc_id", text.alias("t")).where(F.col("t").rlike(CANDIDATE))
    d = d.select("doc_id", text_key(F.col("t")).alias("text_key"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("t", CANDIDATE, -1).alias("p"))
    # what stands before a candidate includes the one before it, which may hold the name that it is assigned to
    d = d.withColumn("last", F.expr(f"transform(c, (x, i) -> if(i = 0, '', right(c[i - 1], {CONTEXT})))"))
    d = d.select("doc_id", "text_key", F.posexplode(F.arrays_zip(F.col("c"), F.expr("slice(p, 1, size(c))").alias("b"), F.expr("slice(p, 2, size(c))").alias("a"), F.col("last"))).alias("number", "x"))
    d = d.select("doc_id", "text_key", "number", F.col("x.c").alias("candidate"), F.length("x.b").alias("gap"), F.expr(f"right(concat(x.last, right(x.b, {CONTEXT})), {CONTEXT})").alias("before"), F.substring("x.a", 1, CONTEXT).alias("after"))
    # rows that repeat have the same candidates: counted before they meet, so that they are no hot key
    d = d.groupBy("doc_id", "text_key", "number", "candidate", "gap", "before", "after").agg(F.count("*").alias("rows"))
    upto = F.sum(F.col("gap") + F.length("candidate")).over(Window.partitionBy("doc_id", "text_key").orderBy("number"))
    d = d.withColumn("start", upto.cast("long") - F.length("candidate"))
    return each_row(d, "rows").select("doc_id", "text_key", "number", "start", "candidate", "before", "after")


def find(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of each row of docs: doc_id, text_key, number, start, candidate, score (0 to 1), secret.

    Null and empty texts and empty tables have none; rows that repeat, and null doc_ids, give their candidates each.
    Other columns than doc_id and text are not read.
    """
    model = model or train(docs.sparkSession)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs))))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "text_key", "number", "start", "candidate", score.alias("score"), (score >= threshold).alias("secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs' rows and columns, each secret in a text replaced (n_chars, where it is a column, follows).

    Rows without secrets, null and empty texts stay as they are; rows that repeat, and those without a doc_id, are each
    redacted. An empty table gives an empty result; further columns stay, whatever their names.
    """
    doc, key, numbers, own, gaps = fresh(docs, "_doc", "_key", "_numbers", "_own", "_gaps")
    found = find(docs, model).where("secret").groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.collect_set("number").alias(numbers))
    found = broadcast_if_small(written(found, "secrets"), BROADCAST_DOCUMENTS)
    text = F.col("text").cast("string")
    a = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key(text) == F.col(key)), "left").drop(doc, key)
    hit = F.col(numbers).isNotNull()
    a = a.withColumns({own: F.when(hit, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))), gaps: F.when(hit, F.split("text", CANDIDATE, -1))})
    pieces = F.transform(own, lambda c, i: F.concat(F.when(F.array_contains(numbers, i), F.lit(placeholder)).otherwise(c), F.get(gaps, i + 1)))
    a = a.withColumn("text", F.when(hit, F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        a = a.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return a.select(*docs.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("number").cast("long").alias("number"), "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


QUERIES, ORACLES = {"op8_secret_scans": op8_secret_scans}, {}
