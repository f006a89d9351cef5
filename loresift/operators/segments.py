"""A text index that changes: segments, tombstones, compaction.

Every batch of changes is a segment: the chunks and postings of the documents it brings, and the ids of all documents
it touches. A document lives in the last segment that touched it; what older segments hold of it is dead, and so is
a document that the segment deleted. Readers leave the dead out by one join on the id. A compaction writes
what lives as a single segment.

The manifest names the segments and the batches that are in them, and is replaced in one step: a batch that is applied
again changes nothing, and a writer that dies leaves files that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import JsonManifest, filesystem
from . import chunk as C
from . import retrieve as R

MANIFEST = "segments.json"
CHANGE = "doc_id string, version long, text string, deleted boolean"


def manifest(spark: SparkSession, path: str) -> dict:
    """{segments: [{id, batch}], retired: folders that the last compaction replaced}."""
    return JsonManifest.read(spark, path, MANIFEST) or {"segments": [], "retired": []}


def latest(changes: DataFrame) -> DataFrame:
    """Of each document of a batch the change with the highest version; of equal versions a deletion, else the larger text."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc(F.coalesce("deleted", F.lit(False))), F.desc("text"))
    return changes.where("doc_id IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply(changes: DataFrame, path: str, batch: str, config: C.Chunking = C.Chunking(), tokenizer: str = "regex") -> bool:
    """Add a batch of changes (doc_id, version, text, deleted) as a segment; False if it is in the index already."""
    spark = changes.sparkSession
    now = manifest(spark, path)
    if any(s["batch"] == batch for s in now["segments"]) or batch in now.get("merged", []):
        return False
    at = f"{path}/segment-{uuid.uuid4().hex}"
    one = latest(changes)
    one.select("doc_id", "version").write.parquet(f"{at}/touched")
    docs = one.where("NOT coalesce(deleted, false) AND text IS NOT NULL").select("doc_id", F.col("version").cast("string").alias("version_id"), "text")
    C.character(docs, config).write.parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    postings = R.text_index(chunks, tokenizer=tokenizer).postings.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.parquet(f"{at}/postings")
    JsonManifest.write(spark, path, MANIFEST, now | {"segments": [*now["segments"], {"id": at, "batch": batch}]})
    return True


def _table(spark: SparkSession, segments: list[dict], name: str) -> DataFrame:
    """Rows of all segments, with the segment's number."""
    out = None
    for n, s in enumerate(segments):
        rows = spark.read.parquet(f"{s['id']}/{name}").withColumn("segment", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def live(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Chunks or postings of the documents as they are now."""
    segments = manifest(spark, path)["segments"]
    if not segments:
        raise ValueError(f"INDEX_NOT_FOUND: no segment in {path}")
    rows = _table(spark, segments, name)
    if len(segments) == 1:
        return rows.drop("segment")
    last = _table(spark, segments, "touched").groupBy("doc_id").agg(F.max("segment").alias("segment"))
    return rows.join(last, ["doc_id", "segment"], "left_semi").drop("segment")


def text_index(spark: SparkSession, path: str) -> R.TextIndex:
    """The inverted index of what lives; statistics follow from it."""
    postings, chunks = live(spark, path, "postings").select("term", "chunk_id", "tf", "dl"), live(spark, path, "chunks")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    tokens = postings.agg(F.sum("tf").alias("tokens"))
    # two rows of one
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(tokens).select("n", F.coalesce(F.nullif(F.col("tokens") / F.col("n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    return R.TextIndex(postings, terms, stats)


def compact(spark: SparkSession, path: str) -> int:
    """Write what lives as one segment; how many it replaces. Folders replaced are deleted by the compaction after
    this one, so that readers of the manifest before can end."""
    now = manifest(spark, path)
    if len(now["segments"]) < 2:
        return 0
    at = f"{path}/segment-{uuid.uuid4().hex}"
    for name in ("chunks", "postings"):
        rows = live(spark, path, name)
        (rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id") if name == "postings" else rows).write.parquet(f"{at}/{name}")
    spark.read.parquet(f"{at}/chunks").select("doc_id", F.col("version_id").cast("long").alias("version")).distinct().write.parquet(f"{at}/touched")
    merged = [*now.get("merged", []), *[s["batch"] for s in now["segments"]]][-1000:]  # batches run again soon, if at all
    JsonManifest.write(spark, path, MANIFEST, {"segments": [{"id": at, "batch": f"compaction-{uuid.uuid4().hex}"}], "merged": merged, "retired": [s["id"] for s in now["segments"]]})
    for old in now["retired"]:
        fs, p = filesystem(spark, old)
        fs.delete(p, True)
    return len(now["segments"])
