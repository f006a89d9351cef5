"""Phrases by positions, and large batches of vector questions."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.operators import phrases as H
from loresift.operators import retrieve as R


def plain(texts, phrase):
    want = re.findall(r"[a-zA-Z0-9_]+|[一-鿿]", phrase.lower())
    out = {}
    for name, t in texts.items():
        own = re.findall(r"[a-zA-Z0-9_]+|[一-鿿]", t.lower())
        at = [i for i in range(len(own) - len(want) + 1) if own[i : i + len(want)] == want]
        if want and at:
            out[name] = (len(at), at[0])
    return out


def search(spark, texts, asked):
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = H.phrase_search(H.positional_index(chunks), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).collect()
    return [{r["chunk_id"]: (r["occurrences"], r["first"]) for r in got if r["query_id"] == i} for i in range(len(asked))]


def test_literals(spark):
    texts = {"a": "To be, or not to be: that is it.", "b": "not   TO be", "c": "be to", "d": "", "e": "aa aa aa aa", "f": "重排序 is 重 排"}
    asked = ["to be", "not to be", "be to", "to", "aa aa", "aa aa aa", "重排", "missing", "to missing", "?!", "that is it to"]
    assert search(spark, texts, asked) == [plain(texts, q) for q in asked]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9).map(" ".join), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=4).map(" ".join), min_size=1, max_size=4))
def test_against_lists(spark, texts, asked):
    named = {f"c{i}": t for i, t in enumerate(texts)}
    assert search(spark, named, asked) == [plain(named, q) for q in asked]


def test_no_text_is_read(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two three"), ("b", "two one")], "chunk_id string, text string")
    H.write(H.positional_index(chunks), f"{tmp_path}/p")
    found = H.phrase_search(spark.read.parquet(f"{tmp_path}/p"), spark.createDataFrame([(1, "two three")], "query_id int, query string"))
    assert [(r["chunk_id"], r["first"]) for r in found.collect()] == [("a", 1)]
    assert "text" not in re.findall(r"\w+", " ".join(re.findall(r"ReadSchema: (.*)", found._jdf.queryExecution().executedPlan().toString())))


@pytest.mark.parametrize("cell", [1 << 16, 40])
def test_many_questions_read_the_vectors_once(spark, monkeypatch, tmp_path, cell):
    r = np.random.default_rng(1)
    v = r.standard_normal((150, 6))
    v[7] = v[3]
    spark.createDataFrame([(f"c{i:03}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, vector array<double>").write.parquet(f"{tmp_path}/v")
    vectors = spark.read.parquet(f"{tmp_path}/v")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.vstack([r.standard_normal((60, 6)), v[3:4], np.zeros((1, 6))]))], "query_id int, vector array<double>")
    key = lambda rows: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in rows)
    want = key(R.vector_search(vectors, q, 4).collect())
    monkeypatch.setattr(R, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(R, "CELL_ROWS", cell)
    many = R.vector_search(vectors, q, 4)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert key(many.collect()) == want and plan.count("chunk_id#") and len(re.findall(r"FileScan parquet", plan)) == 1


def test_index_holds_positions(spark, tmp_path):
    from loresift.engine import Engine
    from loresift.settings import Settings

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("rank fusion merges lists")
    (tmp_path / "raw" / "b.txt").write_text("fusion of rank")
    e = Engine(spark, Settings.of({"allowed": [str(tmp_path)], "index": {"path": f"file://{tmp_path}/index"}}))
    e.build(str(tmp_path / "raw"))
    got = e.phrases(spark.createDataFrame([(1, "Rank  fusion"), (2, "of rank"), (3, "lists rank")], "query_id int, query string")).join(e.index.table("chunks"), "chunk_id").select("query_id", "text", "first").collect()
    assert sorted(map(tuple, got)) == [(1, "rank fusion merges lists", 0), (2, "fusion of rank", 1)]
    assert e.index.table("positions").agg(F.sum("tf")).head()[0] == 7


def test_places_are_counted_in_batches_bounded_in_bytes(spark):
    """Long texts are not brought into one batch of many rows: Arrow's batches end at some bytes."""
    from loresift.sources.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = H.positional_index(spark.createDataFrame([(1, "a b a"), (2, "b")], "chunk_id int, text string"))
    assert int(spark.conf.get(key)) == BATCH_BYTES
    assert sorted((r["term"], r["chunk_id"], r["positions"]) for r in rows.collect()) == [("a", 1, [0, 2]), ("b", 1, [1]), ("b", 2, [0])]
