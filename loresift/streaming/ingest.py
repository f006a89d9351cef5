"""Incremental ingestion: new text rows of a streaming source to the chunks and postings of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk as C
from ..operators import retrieve as R


def ingest(stream: DataFrame, path: str, checkpoint: str, config: C.Chunking = C.Chunking()) -> StreamingQuery:
    """Chunk a stream of (doc_id, text) and append chunks and postings under `path`, once per batch: a batch
    that is run again overwrites its own files."""

    def batch(df: DataFrame, n: int) -> None:
        chunks = C.character(df.dropDuplicates(["doc_id", "text"]), config)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={n}")
        own = df.sparkSession.read.parquet(f"{path}/chunks/batch={n}")
        R.text_index(own).postings.write.mode("overwrite").parquet(f"{path}/postings/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(spark, path: str) -> R.TextIndex:
    """The text index over all batches; statistics follow from the postings and chunks."""
    postings = spark.read.parquet(f"{path}/postings").drop("batch").dropDuplicates(["term", "chunk_id"])
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    chunks = spark.read.parquet(f"{path}/chunks").dropDuplicates(["chunk_id"])
    total = postings.agg(F.sum("tf").alias("tokens"))
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(total).select("n", F.coalesce(F.nullif(F.col("tokens") / F.col("n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    return R.TextIndex(postings, terms, stats)
