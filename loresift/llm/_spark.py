"""Session helpers of the corpus operators: shared intermediate tables, row keys and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the Arrow batches that cross to Python. A batch ends at whichever comes first; a longer text is a
#: batch of its own. One setting for all operators, so that it does not matter which plan was built last.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 16
#: What tells a row from any other (see `identity`).
ROW = "doc_id long, mark long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, whose executors are
    this process, gets one of its own where it is unset."""
    # unions that keep their sides' partitioning zip partitions, which fails where adaptive execution
    # has coalesced the sides differently
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loresift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage so that a
    lost executor costs one stage, and lets several consumers read the rows once computed. The table goes
    with `drop`, or else when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/loresift/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(schema).parquet(at)
    out._kept_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Delete intermediate tables that no later step reads."""
    for t in tables:
        path, fs = _path(t.sparkSession, t._kept_at)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, which it does only once the
    driver has collected the plans that own them."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """(doc_id, mark) of a row, neither of them null. mark is a hash of the text, even where there is an
    id and odd where there is none; there a second hash stands for the id, so that rows without an id are
    told apart by 127 bits and spread over all partitions. Rows equal in both are interchangeable."""
    own = id_.cast("long")
    text = F.coalesce(text, F.lit(""))
    hash_ = F.xxhash64(text).bitwiseAND(F.lit(-2))
    return F.coalesce(own, F.xxhash64(F.lit(1), text)), F.when(own.isNull(), hash_ + 1).otherwise(hash_)


def real_id(doc_id: str | Column = "doc_id", mark: str | Column = "mark") -> Column:
    """The id of the row with a key, null where it has none."""
    doc_id, mark = (F.col(x) if isinstance(x, str) else x for x in (doc_id, mark))
    return F.when(mark.bitwiseAND(F.lit(1)) == 0, doc_id)


def identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (doc_id, mark, text), keyed by `row_key`, so that repeated and missing ids never mix their
    results. Null texts become empty; other columns are left behind."""
    doc_id, mark = row_key(docs[id_col], docs[text_col])
    return docs.select(doc_id.alias("doc_id"), mark.alias("mark"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the key."""
    return (a["doc_id"] == b["doc_id"]) & (a["mark"] == b["mark"])
