"""Cases that an operator once left out."""

import pytest

pytest.importorskip("fleetspark.llm")

from fleetspark.llm import packing, quality_rules, secrets  # noqa: E402

DOCS = "doc_id long, text string"


def found_in(spark, texts: dict[int, str]) -> dict[int, list[str]]:
    """The candidates of each text, in order; each is what stands in the text at its start."""
    rows = secrets.candidates(spark.createDataFrame(list(texts.items()), DOCS)).orderBy("doc_id", "number").collect()
    assert all(texts[r["doc_id"]][r["start"] :].startswith(r["candidate"]) for r in rows)
    return {i: [r["candidate"] for r in rows if r["doc_id"] == i] for i in texts}


def test_values_assigned_to_names_with_digits(spark):
    texts = {1: 'db1_password = "correct!horse" x', 2: 'oauth2_token: "hunt3r!"', 3: "S3_BUCKET_SECRET=abc!defgh", 4: "postgres9-password=Tr0ub4dor&", 5: 'password = "correct!horse"'}
    found = found_in(spark, texts)
    assert [found[i][-1] for i in texts] == ["correct!horse", "hunt3r!", "abc!defgh", "Tr0ub4dor&", "correct!horse"]
    assert [found[i][:-1] for i in texts] == [["db1_password"], ["oauth2_token"], ["S3_BUCKET_SECRET="], ["postgres9-password="], []]


def test_the_name_before_a_value_is_seen_and_the_value_hidden(spark):
    df = spark.createDataFrame([(1, "set db1_password='Xk29!fQz7Lw04mTb' here")], DOCS)
    rows = secrets.with_features(secrets.candidates(df)).orderBy("number").collect()
    assert rows[-1]["candidate"] == "Xk29!fQz7Lw04mTb" and rows[-1]["before"] == "db1_password='" and rows[-1]["named"] == rows[-1]["assigned"] == 1.0
    assert "Xk29" not in secrets.redact(df, secrets.train(spark, 60)).first()["text"]


def test_values_assigned_to_every_name(spark):
    texts = {1: 'access_key = "letmeinnow"', 2: "auth: s3cr!tX", 3: "credential=letmein!", 4: "Access-Key: letmeinnow"}
    assert found_in(spark, texts) == {1: ["letmeinnow"], 2: ["s3cr!tX"], 3: ["letmein!"], 4: ["letmeinnow"]}


def test_a_digit_far_into_a_run(spark):
    texts = {1: "ab/" * 25 + "Z9x8c7v6b5", 2: "see " + "-" * 70 + "a1b2c3d4e5 there", 3: "-" * 70 + " letters" * 9, 4: "x" * 300_000 + "1"}
    assert found_in(spark, texts) == {1: [texts[1]], 2: ["-" * 70 + "a1b2c3d4e5"], 3: [], 4: [texts[4]]}


def test_frequent_pieces_outlast_many_rare_ones(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["The cat, Émile & the dog", " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}q{i}" for i in range(700)), "", "other words; a1 \u0130x", "ÿþ ÀÖ \x07 b"]
    want = [encode.whole(t) for t in texts]
    assert [encode(t.encode()) for t in texts] == want
    assert max(len(encode.words), len(encode.pieces)) <= 100 and {"the", "cat", "émile", "dog"} <= encode.pieces.keys()


def test_counts_of_many_partitions_take_few_files(spark, monkeypatch):
    files = {}

    def written(df, name, codec="zstd", write=quality_rules.written):
        out = write(df, name, codec)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(quality_rules, "written", written)
    docs = spark.range(0, 400, 1, 40).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', 1000 + x * (id + 7) % 9000))) AS text", "'en' AS lang", "'s' AS source")
    assert quality_rules.judge(docs).count() == 400
    assert files["quality-counts"] <= 4
