"""Chunks of documents that come as lines equal those of whole texts, however lines lie in partitions."""

import random

import pytest
from pyspark.sql import functions as F

from loresift.operators import chunk as C
from loresift.operators import lines as L


def text(r, n):
    pieces = ["word", "é", " ", "  ", "\n", "\n\n", "\n# Head ", "\n  ## Two\n", "\n \t\n", "long" * 9, "中文 "]
    return "".join(r.choice(pieces) for _ in range(n))


def texts():
    r = random.Random(4)
    out = {f"d{i}": text(r, r.randrange(0, 120)) for i in range(14)}
    return out | {"none": "", "blank": " \n\n \n", "head": "# only", "lead": "\n\n  first\n# A\n\n\n", "long": text(r, 4000), "one": "x" * 3000}


def docs(spark):
    return spark.createDataFrame([(k, "v", t) for k, t in texts().items()], "doc_id string, version_id string, text string")


@pytest.fixture
def many(spark):
    """More partitions than documents, so that documents are cut."""
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size,overlap", [(50, 10), (7, 0)])
def test_character_windows(many, size, overlap):
    own, config = docs(many), C.Chunking(size, overlap)
    got = L.character(L.lines_of(own), config).select("doc_id", "chunk_index", "char_start", "char_end", "text").collect()
    want = C.character(own, config).select("doc_id", "chunk_index", "char_start", "char_end", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 300


def test_sections(many):
    own, config = docs(many), C.Chunking(40, 10)
    got = L.section_aware(L.lines_of(own), config).select("doc_id", "chunk_index", "section", "text").collect()
    want = C.section_aware(own, config).select("doc_id", "chunk_index", "section", "text").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r["section"] for r in got}) > 3


def test_a_document_lies_in_many_partitions(many):
    rows = L.lines_of(many.createDataFrame([("d", "\n".join(f"line {i}" for i in range(5000)))], "doc_id string, text string"))
    got = L.placed(rows.repartition(5))
    ranged = rows.repartitionByRange("doc_id", "line_no").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) >= 20 and max(r["count"] for r in ranged) < 1000
    at, want = {r["line_no"]: r["char_start"] for r in got.collect()}, 0
    for i in range(5000):
        assert at[i] == want
        want += len(f"line {i}") + 1


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 3, "tail"), ("a", 1, "# H"), (None, 1, "x"), ("a", None, "x"), ("a", 2, None), ("b", 9, "alone")], "doc_id string, line_no long, text string")
    assert sorted(map(tuple, L.placed(rows).select("doc_id", "line_no", "char_start", "section").collect())) == [("a", 1, 0, "H"), ("a", 2, 4, "H"), ("a", 3, 5, "H"), ("b", 9, 0, None)]
    assert sorted(map(tuple, L.character(rows, C.Chunking(100, 0)).collect())) == [("a", 0, 0, 9, "# H\n\ntail"), ("b", 0, 0, 5, "alone")]
    assert L.character(rows.limit(0)).collect() == [] == L.section_aware(rows.limit(0)).collect()
