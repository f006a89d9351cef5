"""The JSON store: ranges, commits, overwriting, and indexes that move between stores."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loresift.operators import index as I
from loresift.operators import retrieve as R
from loresift.sources.stores import FORMAT, LIST, REPOSITORIES, JsonLines, JsonStore, StoreError, collection, local_path, parts_of

ODD = [(1, "a\nb\t\"é\" 中", [1.5, -0.0, 1e300], {"k": "v"}, None), (2, "", [], {}, (3, "x")), (None, None, None, None, (None, None))]
SCHEMA = "id long, text string, v array<double>, m map<string,string>, s struct<a: int, b: string>"


def test_rows_come_back(spark, tmp_path):
    df = spark.createDataFrame(ODD, SCHEMA)
    JsonStore.write(df, f"file://{tmp_path}/t")
    back = JsonStore.read(spark, f"file://{tmp_path}/t")
    assert back.schema.simpleString() == df.schema.simpleString()
    got = {r["id"]: r for r in back.collect()}
    assert got[1]["text"] == ODD[0][1] and got[1]["v"] == ODD[0][2] and got[1]["m"] == {"k": "v"} and got[1]["s"] is None
    assert got[2]["text"] == "" and got[2]["v"] == [] and got[2]["s"]["b"] == "x" and got[None]["text"] is None
    JsonStore.write(df.limit(0), f"{tmp_path}/none")
    assert JsonStore.read(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, size):
    df = spark.range(200).select("id", F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("t")).repartition(3)
    JsonStore.write(df, str(tmp_path / "t"))
    back = JsonStore.read(spark, str(tmp_path / "t"), range_bytes=size if size > 1 else 16)
    assert back.rdd.getNumPartitions() >= (3 if size == 1 << 20 else 20)
    assert sorted((r["id"], r["t"]) for r in back.collect()) == [(i, "é" * (i % 9)) for i in range(200)]


def test_a_task_that_dies_half_way_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    JsonStore.write(spark.range(10), at)
    before = sorted(os.listdir(at))
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("died")).cast("long")).otherwise(F.col("id")).alias("id"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="died"):
            JsonStore.write(bad, at, mode)
        assert sorted(r["id"] for r in JsonStore.read(spark, at).collect()) == list(range(10))
    JsonStore.vacuum(at)  # tasks that ended after the job did
    assert sorted(os.listdir(at)) == [x for x in before if not x.startswith(".")]
    with pytest.raises(Exception, match="died"):
        JsonStore.write(bad, str(tmp_path / "new"))
    with pytest.raises(StoreError, match="INDEX_NOT_FOUND"):
        JsonStore.read(spark, str(tmp_path / "new"))


def test_parts_that_no_list_names_are_not_there(spark, tmp_path):
    at = str(tmp_path / "t")
    JsonStore.write(spark.range(3), at)
    (tmp_path / "t" / "part-stray.jsonl").write_text('{"id": 99}\n')
    assert JsonStore.read(spark, at).count() == 3
    JsonStore.write(spark.range(3, 5), at, "append")
    assert JsonStore.read(spark, at).count() == 5
    JsonStore.write(spark.range(1), at)
    said = parts_of(at)
    assert JsonStore.read(spark, at).count() == 1 == sum(p["rows"] for p in said["parts"])
    assert {p["name"] for p in said["parts"]} | {LIST, "part-stray.jsonl"} == {x for x in os.listdir(at) if not x.startswith(".")}


def test_plain_lines(spark, tmp_path):
    spark.dataSource.register(JsonLines)
    spark.createDataFrame([("{}",), ("[1]",)], "value string").write.format(FORMAT).mode("append").save(str(tmp_path / "x"))
    assert sorted(r["value"] for r in spark.read.format(FORMAT).load(str(tmp_path / "x")).collect()) == ["[1]", "{}"]
    with pytest.raises(StoreError, match="INVALID_CONFIG"):
        local_path("s3://bucket/x")
    assert local_path("file:///a/b") == local_path("file:/a/b") == "/a/b"


def test_registries():
    assert set(REPOSITORIES) == {"documents", "chunks", "vectors", "manifest"}
    for name, registry in REPOSITORIES.items():
        assert registry["local_json"] and registry[" local_json "]
        with pytest.raises(KeyError, match=registry.kind):
            registry["memory"]
        with pytest.raises(ValueError):
            registry.register("local_json", registry["local_json"])
        with pytest.raises(ValueError):
            registry.register(" ", registry["local_json"])


def test_an_index_moves_between_stores(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for i in range(4):
        (tmp_path / "raw" / f"{i}.md").write_text(f"# Title {i}\n\nalpha beta word{i}\n")
    json_stores = {"documents": "local_json", "chunks": "local_json", "vectors": "local_json"}
    m = I.build(spark, str(tmp_path / "raw"), f"file://{tmp_path}/one", stores=json_stores)
    first = I.load(spark, f"file://{tmp_path}/one")
    assert m.stores == json_stores and first.table("vectors").count() == 4 and os.path.exists(m.tables.removeprefix("file://") + f"/vectors/{LIST}")
    I.copied(first, f"file://{tmp_path}/two", dict.fromkeys(json_stores, "parquet"))
    second = I.load(spark, f"file://{tmp_path}/two")
    I.copied(second, f"file://{tmp_path}/three", json_stores)
    third = I.load(spark, f"file://{tmp_path}/three")
    assert first.manifest.index_id == second.manifest.index_id == third.manifest.index_id
    q = spark.createDataFrame([(1, "word2"), (2, "beta")], "query_id int, query string")
    found = [sorted(map(str, R.search(x.corpus(), q, "hybrid").select("query_id", "chunk_id", "score", "rank", "text").collect())) for x in (first, second, third)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 2
    again = I.build(spark, str(tmp_path / "raw"), f"file://{tmp_path}/one", stores=json_stores)
    assert again.counts["skipped"] == 4 and again.counts["cache_miss"] == 0
    with pytest.raises(KeyError):
        I.build(spark, str(tmp_path / "raw"), f"file://{tmp_path}/one", stores={"vectors": "none"})


def test_collections_of_one_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dimension": 2, "records": [{"chunk_id": "a", "vector": [0.5, 1.0], "metadata": {"doc_id": "d"}}, {"chunk_id": "b", "vector": [1.0, 0.0], "metadata": {"doc_id": "d"}}]}, indent=2))
    rows = collection(spark, f"file://{tmp_path}/c.json", "records")
    JsonStore.write(rows, str(tmp_path / "t"))
    assert [(r["chunk_id"], r["vector"], r["metadata"]["doc_id"]) for r in JsonStore.read(spark, str(tmp_path / "t")).orderBy("chunk_id").collect()] == [("a", [0.5, 1.0], "d"), ("b", [1.0, 0.0], "d")]
