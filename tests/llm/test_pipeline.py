"""The pipeline's stages on a small table, each against a plain restatement of what it keeps."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loresift.llm.bpe import vocabulary  # noqa: E402
from tests.llm.test_jaccard import brute as brute_copies  # noqa: E402
from tests.llm.test_repeats import brute  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    cols = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "substrings", "mixture", "tokens"]

    one = stages["language"](spark, docs, DIR)
    assert one.columns == cols
    kept = {r["doc_id"] for r in one.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)

    two = stages["near_duplicates"](spark, docs, DIR)
    assert two.columns == cols
    root, first = brute_copies({i: r["text"] for i, r in rows.items()}), {}
    for i in sorted(rows):
        first.setdefault(root[i], i)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())

    three = stages["substrings"](spark, docs, DIR)
    assert three.columns == cols
    words = {i: (r["text"] or "").encode().split() for i, r in rows.items()}
    want = {}
    for (i, w), gone in zip(words.items(), brute(list(words.values()), 35)):
        left = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        if left or not gone.any():
            want[i] = left if gone.any() else rows[i]["text"]
    got = three.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    four = stages["mixture"](spark, docs, DIR)
    assert four.columns == cols
    taken = Counter(r["doc_id"] for r in four.collect())
    total = sum(len(w) for w in words.values())
    assert max(taken.values()) <= 2 and abs(sum(len(words[i]) * n for i, n in taken.items()) / total - 1.5) < 0.15

    lib = Tokenizer.from_file(vocabulary() + ".json")
    five = {r["doc_id"]: r for r in stages["tokens"](spark, docs, DIR).collect()}
    assert all(five[i]["token_ids"] == lib.encode(r["text"], add_special_tokens=False).ids for i, r in rows.items())


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and {"doc_id", "n_tokens", "token_ids"} <= set(out.columns)


def test_odd_rows_and_an_empty_table(spark):
    """Null and empty texts, null ids, repeated rows and columns with names of the operators' own pass every
    stage; texts without a letter go in the first, which keeps the rest."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = [(None, "Some words of a plain text without an id.", "en", "s"), (7001, None, "en", None), (7002, "", None, "s"), (7003, "short", "en", "s"), (7003, "short", "en", "s"), (None, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], docs.schema))
    for extra in ("mark", "row", "key", "_id", "size", "passes", "kept"):
        rows = rows.withColumn(extra, F.lit("x"))
    stages = corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        out = stage(spark, rows, DIR)
        assert out.columns == rows.columns, name
        if name == "language":
            assert {r["doc_id"] for r in out.collect()} >= {7003, None} and out.where("doc_id in (7001, 7002)").count() == 0
        assert out.count() > 0
        assert stage(spark, rows.limit(0), DIR).count() == 0
    assert stages[-1][1](spark, rows, DIR).count() == rows.count() and stages[-1][1](spark, rows.limit(0), DIR).count() == 0
    assert "n_chars" not in dict(stages)["substrings"](spark, rows.drop("n_chars"), DIR).columns
