"""Indexes that change: every state equals a full rebuild, from batches and from streams."""

import os

import pytest
from pyspark.sql import functions as F

from loresift.operators import chunk as C
from loresift.operators import retrieve as R
from loresift.operators import segments as S
from loresift.streaming.latest import follow

CONFIG = C.Chunking(12, 4)


def changes(spark, rows):
    return spark.createDataFrame(rows, S.CHANGE)


def state(spark, path):
    index = S.text_index(spark, path)
    chunks = sorted(map(tuple, S.live(spark, path, "chunks").select("doc_id", "version_id", "chunk_index", "text").collect()))
    stats = index.stats.head()
    return chunks, sorted(map(tuple, index.postings.select("term", "chunk_id", "tf", "dl").collect())), sorted(map(tuple, index.terms.collect())), (stats["n"], round(stats["avgdl"], 9))


def rebuilt(spark, docs):
    rows = C.character(spark.createDataFrame([(i, str(v), t) for i, (v, t) in docs.items()], "doc_id string, version_id string, text string"), CONFIG)
    index = R.text_index(rows)
    stats = index.stats.head()
    return sorted(map(tuple, rows.select("doc_id", "version_id", "chunk_index", "text").collect())), sorted(map(tuple, index.postings.select("term", "chunk_id", "tf", "dl").collect())), sorted(map(tuple, index.terms.collect())), (stats["n"], round(stats["avgdl"], 9))


def test_updates_and_deletions_equal_a_rebuild(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="INDEX_NOT_FOUND"):
        S.live(spark, path, "chunks")
    first = changes(spark, [("a", 1, "alpha beta gamma delta", False), ("b", 1, "beta beta", False), ("c", 1, "", False), ("a", 0, "older", False), (None, 1, "x", False)])
    assert S.apply(first, path, "1", CONFIG) and not S.apply(first, path, "1", CONFIG)
    assert state(spark, path) == rebuilt(spark, {"a": (1, "alpha beta gamma delta"), "b": (1, "beta beta")})
    S.apply(changes(spark, [("a", 2, "epsilon alpha", False), ("b", 2, None, True), ("d", 1, "zeta", None)]), path, "2", CONFIG)
    docs = {"a": (2, "epsilon alpha"), "d": (1, "zeta")}
    assert state(spark, path) == rebuilt(spark, docs)
    S.apply(changes(spark, [("b", 3, "beta again", False), ("b", 3, "beta", True)]), path, "3", CONFIG)  # a deletion wins
    S.apply(changes(spark, [("c", 5, "eta theta iota kappa", False)]), path, "4", CONFIG)
    docs["c"] = (5, "eta theta iota kappa")
    assert state(spark, path) == rebuilt(spark, docs)
    assert S.compact(spark, path) == 4 and S.compact(spark, path) == 0
    assert state(spark, path) == rebuilt(spark, docs) and not S.apply(first, path, "1", CONFIG)
    S.apply(changes(spark, [("d", 2, "zeta two", False)]), path, "5", CONFIG)
    docs["d"] = (2, "zeta two")
    assert S.compact(spark, path) == 2 and state(spark, path) == rebuilt(spark, docs)
    assert len([x for x in os.listdir(tmp_path / "index") if x.startswith("segment-")]) == 3  # one, and the two before
    q = spark.createDataFrame([(1, "zeta theta")], "query_id int, query string")
    chunks = S.live(spark, path, "chunks")
    assert {r["doc_id"] for r in R.bm25(chunks, q, 5, index=S.text_index(spark, path)).join(chunks, "chunk_id").collect()} == {"c", "d"}


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    S.apply(changes(spark, [("a", 1, "alpha", False)]), path, "1", CONFIG)
    before = state(spark, path)
    bad = changes(spark, [("a", 2, "beta", False)]).withColumn("text", F.when(F.col("version") > 1, F.raise_error(F.lit("died")).cast("string")))
    with pytest.raises(Exception, match="died"):
        S.apply(bad, path, "2", CONFIG)
    assert state(spark, path) == before


def test_streams_keep_the_latest_version(spark, tmp_path):
    path, inbox = f"file://{tmp_path}/index", f"{tmp_path}/in"

    def arrive(rows):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        # every call is a restart from the checkpoint
        follow(spark.readStream.schema(S.CHANGE).parquet(inbox), path, f"{tmp_path}/cp", CONFIG, compact_at=3).awaitTermination()

    arrive([("a", 3, "alpha three", False), ("b", 1, "beta one", False), ("b", 2, "beta two", False), ("c", 1, "gamma", False)])
    docs = {"a": (3, "alpha three"), "b": (2, "beta two"), "c": (1, "gamma")}
    assert state(spark, path) == rebuilt(spark, docs)
    arrive([("a", 3, "alpha three", False), ("a", 2, "alpha late", False), ("c", 2, "gamma", False)])  # repeated, late, the same text
    assert state(spark, path) == rebuilt(spark, docs) and len(S.manifest(spark, path)["segments"]) == 1
    arrive([("b", 3, "beta changed", False), ("c", 3, None, True), ("d", 1, "delta", False)])
    docs = {"a": (3, "alpha three"), "b": (3, "beta changed"), "d": (1, "delta")}
    assert state(spark, path) == rebuilt(spark, docs)
    arrive([("c", 2, "gamma late", False), ("b", 2, "beta two", False)])  # after a deletion and a change
    assert state(spark, path) == rebuilt(spark, docs)
    arrive([("c", 4, "gamma again", False)])
    docs["c"] = (4, "gamma again")
    assert state(spark, path) == rebuilt(spark, docs) and len(S.manifest(spark, path)["segments"]) == 1  # compacted
