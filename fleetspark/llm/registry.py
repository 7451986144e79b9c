"""The queries and SQL of this subpackage, for ``__spark_entry__.py``; importing it imports every operator."""

from __future__ import annotations

from fleetspark.llm import decontamination, minhash, packing, quality, quality_rules, secrets, substrings, toxicity, urls, warc

MODULES = [minhash, toxicity, urls, decontamination, quality_rules, warc, quality, secrets, substrings, packing]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
