"""The stages against brute force on a small corpus."""

import re

import pytest

pytest.importorskip("fleetspark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_operators import DOCS, LABELS, prose, shingle_set  # noqa: E402


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from fleetspark.llm import packing

    item = prose(500, 20)
    rows = [(i, prose(i, 70)) for i in range(40)]
    rows += [(50, rows[3][1] + " extra"), (51, rows[4][1]), (52, prose(52, 60) + " " + item), (53, prose(53, 60) + " password=7602ad27cf5550de1c end"), (54, "too short"), (55, None), (56, " ".join(f"{w}###" for w in prose(56, 70).split()))]
    rows += [rows[7], (None, prose(600, 70)), (None, prose(600, 70)), (None, rows[8][1]), (None, None)]  # repeats, and rows without a doc_id
    clash = [f"{c}" for c in ("_key", "component_id")]
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    table.withColumns(dict.fromkeys(clash, F.lit("clash"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = {i: t for i, t in rows if i is not None and (i < 40 or i == 53)} | {None: prose(600, 70)}
    expected[53] = expected[53].replace("7602ad27cf5550de1c", "[SECRET]")
    for a in range(40):  # the fixture has no other near copies
        for b in range(a):
            x, y = shingle_set(rows[a][1], 5), shingle_set(rows[b][1], 5)
            assert len(x & y) < 0.8 * len(x | y)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "packing"]
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None}
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        gone.append(before - {r["doc_id"] for r in docs.collect()})
    assert gone == [{54, 55, 56}, {50, 51}, {52}, set()]
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected and docs.count() == len(expected)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids: dict[int, list[int]] = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (str(r["doc_id"]), r["start"])):
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in expected.items()}
    assert not re.search("7602ad27cf5550de1c", str(expected))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
