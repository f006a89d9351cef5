"""Ranking, fusion, reranking, planning, comparison."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.operators import embed as E
from loresift.operators import plan_queries as Q
from loresift.operators import retrieve as R


def hits(spark, rows):
    return spark.createDataFrame([(1, c, float(s), r) for r, (c, s) in enumerate(rows, 1)], "query_id int, chunk_id string, score double, rank int")


def order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_fusion_literals(spark):
    v, b = hits(spark, [("a", 0.95), ("b", 0.80)]), hits(spark, [("b", 8.5), ("c", 7.0)])
    assert order(R.fuse([("vector", v, 1.0), ("bm25", b, 1.0)], 3)) == ["b", "a", "c"]
    assert order(R.fuse([("vector", v, 2.0), ("bm25", b, 1.0)], 3))[0] == "b"
    only = R.fuse([("vector", hits(spark, [("a", 1)]), 2.0), ("bm25", hits(spark, [("b", 1)]), 1.0)], 1).head()
    assert only["chunk_id"] == "a" and only["score"] == round(2 / 61, 6) and only["signals"][0]["retriever"] == "vector"
    again = hits(spark, [("a", 1), ("a", 1), ("b", 1)])  # a repeat uses up its rank
    got = {r["chunk_id"]: r["score"] for r in R.fuse([("x", again, 1.0), ("y", hits(spark, [("z", 1)]), 1.0)], 9).collect()}
    assert got["b"] == round(1 / 63, 6)
    with pytest.raises(ValueError):
        R.fuse([("x", v, 1.0), ("x", b, 1.0)], 3)
    asked = []
    R.hybrid({n: lambda k: asked.append(k) or v for n in ("one", "two")}, 5)
    assert asked == [15, 15]


def test_multi_query_merge(spark):
    q = spark.createDataFrame([(1, "x")], "query_id int, query string")
    rows = R.candidates([hits(spark, [("a", 2), ("b", 1)]), hits(spark, [("b", 2), ("c", 1)])])
    assert order(R.ResultStages(top_k=5).apply(rows, q)) == ["a", "b", "c"]
    assert R.ResultStages(3, True).fetch() == 12 and R.ResultStages(3).fetch() == 3
    with pytest.raises(ValueError):
        R.ResultStages(13, True)


def test_rerank(spark):
    q = spark.createDataFrame([(1, "rerank latency")], "query_id int, query string")
    rows = hits(spark, [("a", 2), ("b", 1)]).join(spark.createDataFrame([("a", "rerank improves ordering"), ("b", "rerank adds latency during retrieval")], "chunk_id string, text string"), "chunk_id")
    got = R.rerank(rows, q).orderBy("rank").collect()
    assert [(r["chunk_id"], r["retrieval_rank"]) for r in got] == [("b", 2), ("a", 1)]
    assert got[0]["rerank_score"] == round(2.0 + 2 / math.sqrt(5), 6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=12).map(" ".join), min_size=1, max_size=9), st.lists(st.sampled_from("abcdefz"), min_size=1, max_size=5).map(" ".join))
def test_bm25_equals_the_formula(spark, texts, question):
    docs = {f"c{i}": t.split() for i, t in enumerate(texts)}
    n, avg = len(docs), (sum(map(len, docs.values())) / len(docs)) or 1.0
    df = Counter(t for d in docs.values() for t in set(d))

    def score(d):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in question.split() if t in d)

    want = sorted(((-round(score(d), 9), c) for c, d in docs.items() if score(d) > 0))[:3]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, question)], "query_id int, query string")
    for index in (None, R.text_index(chunks)):
        got = R.bm25(chunks, q, 3, index=index).orderBy("rank").collect()
        assert [r["chunk_id"] for r in got] == [c for _, c in want]
        assert all(abs(r["score"] + s) < 1e-4 for r, (s, _) in zip(got, want))


def test_bm25_of_few_questions_shuffles_no_postings(spark, monkeypatch):
    """A task holds the best of its chunks, whatever their number: no aggregate over terms or pairs; repeated and null
    ids count as one chunk, as in SQL."""
    import random

    r = random.Random(6)
    texts = [(i // 2 if i % 9 == 0 else None if i % 50 == 1 else 1000 + i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 30)))) for i in range(300)]
    texts += [(2000 + i, "a b c d") for i in range(40)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(r.choice("abcdefghz") for _ in range(4))) for i in range(12)], "query_id int, query string")
    monkeypatch.setattr(R, "PAIRS", 64)
    plan = R.bm25(chunks.where("chunk_id >= 1000"), asked, 7)._jdf.queryExecution().optimizedPlan().toString()
    got = R.bm25(chunks, asked, 7)
    assert "Aggregate" not in plan and "MapInArrow" in plan
    scores = R.bm25_scores(chunks, asked, index=R.text_index(chunks))
    want = R.ranked(scores, 7, F.desc(F.round("score", 9)), F.col("chunk_id")).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
    key = lambda x: (x["query_id"], x["rank"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_vectors(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((60, 8))
    v[7], v[9] = v[3], 0
    df = spark.createDataFrame([(f"c{i:02}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((4, 8)))] + [(9, v[3].tolist())], "query_id int, vector array<double>")
    for row in q.collect():
        s = v @ np.array(row["vector"]) / np.where((d := np.linalg.norm(v, axis=1) * np.linalg.norm(row["vector"])) == 0, 1, d)
        want = [f"c{i:02}" for _, i in sorted((-round(x, 12), i) for i, x in enumerate(s))[:6]]
        assert order(R.vector_search(df, q, 6).where(F.col("query_id") == row["query_id"])) == want
    assert R.vector_search(df, q.limit(0), 6).count() == 0


def test_hash_embedding(spark):
    for d in (3, 16, 64, 100):
        x = E.hash_vector("文本", dimension=d)
        assert len(x) == d and abs(sum(a * a for a in x) - 1) < 1e-9
    df = spark.createDataFrame([("a",), ("a",), (None,)], "text string").select(E.hash_embedding()("text").alias("v"))
    got = [r["v"] for r in df.collect()]
    assert got[0] == got[1] == E.hash_vector("a") and got[2] is None
    ok = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "v array<double>").select(E.valid_vector(F.col("v"), 2).alias("ok"))
    assert [r["ok"] for r in ok.collect()] == [True, False, False, False]


def test_planning(spark):
    q = spark.createDataFrame([(1, " 重排序  的 reranker "), (2, "plain")], "query_id int, query string")
    got = {r["query_id"]: r for r in Q.rule_based(q, 1).collect()}
    assert got[1]["primary_query"] == "重排序 的 reranker reranking" and got[1]["additional_queries"] == ["reranking"]
    assert got[2]["primary_query"] == "plain" and got[2]["keywords"] == []
    said = q.withColumn("payload", F.when(F.col("query_id") == 1, F.lit('{"primary_query": " p ", "additional_queries": ["a", "a", "p", " ", "b", "c"], "keywords": ["k"]}')).otherwise("no json"))
    got = {r["query_id"]: r for r in Q.from_model(said).collect()}
    assert got[1]["primary_query"] == "p" and got[1]["additional_queries"] == ["a", "b"] and not got[1]["fallback_used"]
    assert got[2]["primary_query"] == "plain" and got[2]["fallback_used"]
    assert [(r["query_id"], r["query"]) for r in Q.retrieval_queries(Q.rule_based(q, 1)).orderBy("query_id", "query_pos").collect()] == [(1, "重排序 的 reranker reranking"), (1, "reranking"), (2, "plain")]


def test_compare(spark):
    def broken():
        raise KeyError("INVALID_CONFIG: no such strategy")

    found, errors, status = R.compare({"vector": lambda: hits(spark, [("a", 1), ("b", 1)]), "bm25": lambda: hits(spark, [("b", 1), ("a", 1)]), "none": broken})
    assert status == "partial_error" and set(errors) == {"none"}
    assert {r["chunk_id"]: r["ranks"] for r in R.overlaps(found).collect()} == {"a": {"vector": 1, "bm25": 2}, "b": {"vector": 2, "bm25": 1}}
    assert R.compare({"none": broken})[2] == "error"
    with pytest.raises(ValueError):
        R.compare({"a": broken, " a ": broken})


def test_missing_chunk_is_an_error(spark):
    chunks = spark.createDataFrame([("a", "t")], "chunk_id string, text string")
    with pytest.raises(Exception, match="RETRIEVAL_FAILED"):
        R.with_chunks(hits(spark, [("a", 1), ("zz", 1)]), chunks).collect()
    ids = spark.createDataFrame([("zz", 0), ("a", 1)], "chunk_id string, pos int")
    assert [r["chunk_id"] for r in R.multi_get(ids, chunks).collect()] == ["a"]
    assert re.match("retriever", R.RETRIEVERS.kind)
    with pytest.raises(KeyError):
        R.RETRIEVERS["nope"]
    with pytest.raises(ValueError):
        R.RETRIEVERS.register(" ", len)
    with pytest.raises(ValueError):
        R.RETRIEVERS.register("bm25", len)
