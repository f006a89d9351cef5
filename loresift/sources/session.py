"""Session settings that the engine's plans rely on, and tables that several plans share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def prepared(spark: SparkSession) -> SparkSession:
    """Unions that keep their sides' partitioning zip partitions, which fails where adaptive execution has
    coalesced the sides differently; without that they are plain unions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Size of the Arrow batches that cross to Python; a batch ends at whichever comes first, a longer row is one of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 16


def batched(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


class Tables:
    """Owner of the tables that are stored while it is entered. They go when it is left, or with `drop`, for
    results that are read later. `written` says of each what was measured while it was written."""

    def __init__(self):
        self.written: list[dict] = []
        self._at: list[tuple[SparkSession, str]] = []
        self._entered = None

    def add(self, spark: SparkSession, at: str, said: dict) -> None:
        self._at.append((spark, at))
        self.written.append(said)

    def enter(self) -> Tables:
        """Own what is stored from now on, until `leave`."""
        self._entered = _OWNER.set(self)
        return self

    def leave(self) -> None:
        if self._entered is not None:
            _OWNER.reset(self._entered)
            self._entered = None

    def drop(self) -> None:
        for spark, at in self._at:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self._at = []

    def __enter__(self) -> Tables:
        return self.enter()

    def __exit__(self, *_) -> None:
        self.leave()
        self.drop()


_OWNER: ContextVar[Tables | None] = ContextVar("owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session gets one of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loresift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def counted(df: DataFrame, seen: Observation) -> DataFrame:
    """`df` with its rows counted by whatever job reads it."""
    return df.observe(seen, F.count(F.lit(1)).alias("rows"))


def rows_seen(seen: Observation) -> int:
    """The count of `counted`, once a job has run; a plan that was found empty counts nothing."""
    return seen.get.get("rows", 0)


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` computed once and read back by all who use it, from the shared folder. The table goes with the `Tables`
    that own it, or else when the driver ends."""
    spark, owner = df.sparkSession, _OWNER.get()
    at = f"{shared_folder(spark)}/loresift/{what}-{uuid.uuid4().hex}"
    seen, began = Observation(), time.perf_counter()
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    if owner:
        owner.add(spark, at, said := {"table": what})
    counted(df, seen).write.parquet(at)
    if owner:
        said |= {"rows": rows_seen(seen), "ms": round((time.perf_counter() - began) * 1000, 2)}
    return spark.read.schema(df.schema).parquet(at)
