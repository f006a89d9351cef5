"""Extension points, strategies that fail while they run, and what a run leaves behind."""

import json

import pytest
from pyspark.sql import functions as F

from loresift.operators import context as X
from loresift.operators import evaluate as V
from loresift.operators import retrieve as R
from loresift.operators.reports import write_evaluation
from loresift.plans import catalogue


def test_tokenizers_and_estimators_by_name(spark):
    rows = spark.createDataFrame([(1, "red,green"), (2, "blue")], "chunk_id int, text string")
    R.TOKENIZERS.register("commas", lambda c: F.split(c, ","), replace=True)
    assert sorted(r["term"] for r in R.text_index(rows, tokenizer="commas").terms.collect()) == ["blue", "green", "red"]
    X.ESTIMATORS.register("chars", F.length, replace=True)
    assert rows.select(X.Budget(estimator="chars").tokens(F.col("text")).alias("n")).agg(F.sum("n")).head()[0] == 13
    for registry in (R.TOKENIZERS, X.ESTIMATORS):
        with pytest.raises(KeyError):
            registry["none"]
        with pytest.raises(ValueError):
            registry.register("regex", F.length)
        with pytest.raises(ValueError):
            registry.register("  ", F.length)


def test_an_index_for_given_questions_ranks_like_a_whole_one(spark):
    rows = spark.createDataFrame([(1, "a b c a"), (2, "b b d"), (3, ""), (4, "e")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "d zz"), (3, "")], "query_id int, query string")
    own, whole = R.text_index(rows, asked), R.text_index(rows)
    assert own.stats.head() == whole.stats.head() and own.postings.count() == 4
    assert sorted(R.bm25(rows, asked, 9, index=own).collect()) == sorted(R.bm25(rows, asked, 9, index=whole).collect())


def test_a_strategy_that_fails_while_it_runs(spark):
    hits = spark.createDataFrame([(1, "c", 1.0, 1)], "query_id int, chunk_id string, score double, rank int")
    broken = hits.withColumn("score", F.raise_error(F.lit("no model")).cast("double"))
    found, errors, status = R.compare({"good": lambda: hits, "bad": lambda: broken})
    assert status == "partial_error" and list(errors) == ["bad"] and "no model" in errors["bad"]
    assert [r["strategy"] for r in found.collect()] == ["good"]
    assert R.compare({"bad": lambda: broken})[::2] == (None, "error")


@pytest.mark.parametrize("runs", [False, True])
@pytest.mark.parametrize("bad", [1, 2])
def test_a_failed_strategy_ends_compare_overlap(spark, monkeypatch, bad, runs):
    """Its rows can't say that a strategy failed, in its plan or while it runs; no rows would look like no overlaps."""
    own, calls = R.bm25, []

    def bm25(*args, **more):
        calls.append(args)
        if len(calls) != bad:
            return own(*args, **more)
        if not runs:
            raise OSError("no disk")
        return own(*args, **more).withColumn("score", F.raise_error(F.lit("no disk")).cast("double"))

    monkeypatch.setattr(R, "bm25", bm25)
    with pytest.raises(Exception, match="no disk"):
        catalogue.QUERIES["compare_overlap"](spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == bad


def test_review_columns_and_run_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "plain", "success")], "query_id int, question_type string, status string")
    for m in V.METRICS:
        rows = rows.withColumn(m, F.lit(1.0))
    assert rows.transform(V.with_review).select("review.faithfulness", "review.notes").head() == (None, None)
    write_evaluation(rows, V.summary(rows), f"file://{tmp_path}", {"retriever": "bm25", "index": {"chunks": 3}})
    said = spark.read.text(f"file://{tmp_path}/run.json").head()[0]
    assert json.loads(said) == {"retriever": "bm25", "index": {"chunks": 3}}
