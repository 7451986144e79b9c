"""A training corpus from raw documents: quality rules, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's documents to
the shared folder and reads them for the next. All but the last return the columns of documents, further ones included.

Every stage takes rows without a doc_id, rows that repeat, null and empty texts, texts of any length and empty tables:
rows are judged each on their own, but for the near-dedup stage, which leaves one row of those that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspark.llm import decontamination, minhash, packing, quality_rules, secrets
from fleetspark.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; null, empty and short texts are among these."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): the least doc_id's, one without a doc_id only where all lack it."""
    return minhash.drop_near_duplicates(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a ten-word window of a benchmark item; null texts and rows without a doc_id are judged like others."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids; every row is a document, a null text an end token alone."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality_rules", keep_good), ("near_dedup", keep_one_of_each), ("decontamination", keep_unseen), ("secret_scans", hide_secrets), ("packing", packed)]

#: The forest, the signatures and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
