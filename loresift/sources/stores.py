"""Stores of an index's tables, chosen by name: Parquet, and JSON lines in a folder that all executors share.

The JSON store is a Spark data source of its own, `loresift_json`, a table of one string column `value`, a JSON
object a line. What a table holds is what its list of parts names: tasks write parts under other names,
the list is replaced in one step once all of them are done, and parts that no list names are not there. Readers cut
the parts into ranges of bytes, so a large part is read by many tasks.

Values become JSON, and JSON values, by Spark's own to_json and from_json; the schema is kept in the list.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..registry import Registry

LIST, FORMAT = "_parts.json", "loresift_json"
RANGE_BYTES, BATCH_BYTES = 8 << 20, 1 << 20


class StoreError(ValueError):
    """A store that can't be used; the code comes first in the message."""


def local_path(path: str) -> str:
    """The path of a folder that executors reach as files."""
    bare = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in bare:
        raise StoreError(f"INVALID_CONFIG: the store local_json needs a folder of files, not {path}")
    return os.path.abspath(bare)


def parts_of(folder: str) -> dict:
    """The list of a table's parts; without one the table is empty."""
    try:
        with open(f"{folder}/{LIST}", encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {"parts": [], "schema": None}


@dataclass
class Range(InputPartition):
    """Bytes of a part: its lines that begin there."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """A part that a task wrote."""

    name: str
    rows: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        return [Range(f"{self.folder}/{p['name']}", a, min(a + self.range_bytes, p["size"])) for p in parts_of(self.folder)["parts"] for a in range(0, p["size"], self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without parts
            return
        batch, size = [], 0
        with open(partition.file, "rb") as f:
            if partition.start:  # a line that began before belongs to the range before
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end and (line := f.readline()):
                batch.append(line.rstrip(b"\n"))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary()).cast(pa.string())], names=["value"])
                    batch, size = [], 0
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary()).cast(pa.string())], names=["value"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: str | None, overwrite: bool):
        self.folder, self.schema, self.overwrite = folder, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.jsonl"  # a name of its own for every attempt
        hidden, rows, size = f"{self.folder}/.{name}", 0, 0
        try:
            with open(hidden, "wb") as f:
                for batch in iterator:
                    for value in batch.column("value").cast(pa.binary()).to_pylist():
                        size += f.write(value + b"\n")
                        rows += 1
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.unlink(hidden)
            raise
        os.replace(hidden, f"{self.folder}/{name}")
        return Written(name, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        before = parts_of(self.folder)
        kept = [] if self.overwrite else before["parts"]
        new = [{"name": m.name, "rows": m.rows, "size": m.size} for m in messages if m is not None]
        os.makedirs(self.folder, exist_ok=True)
        hidden = f"{self.folder}/.{LIST}-{uuid.uuid4().hex}"
        with open(hidden, "w", encoding="utf-8") as f:
            json.dump({"parts": kept + new, "schema": self.schema or before["schema"]}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(hidden, f"{self.folder}/{LIST}")
        if self.overwrite:
            self._remove(p["name"] for p in before["parts"])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(m.name for m in messages if m is not None)

    def _remove(self, names) -> None:
        for name in names:
            if os.path.exists(f"{self.folder}/{name}"):
                os.unlink(f"{self.folder}/{name}")


class JsonLines(DataSource):
    """The data source behind the store `local_json`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(local_path(self.options["path"]), int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(local_path(self.options["path"]), self.options.get("tableschema"), overwrite)


class ParquetStore:
    """A table as Parquet files, in any store that Spark writes."""

    @staticmethod
    def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path)


class JsonStore:
    """A table as JSON lines in a shared folder."""

    @staticmethod
    def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
        df.sparkSession.dataSource.register(JsonLines)
        lines = df.select(F.to_json(F.struct(*[df[c] for c in df.columns])).alias("value"))
        lines.write.format(FORMAT).mode(mode).option("tableschema", df.schema.json()).save(local_path(path))

    @staticmethod
    def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
        spark.dataSource.register(JsonLines)
        schema = parts_of(local_path(path))["schema"]
        if schema is None:
            raise StoreError(f"INDEX_NOT_FOUND: no table in {path}")
        kind = StructType.fromJson(json.loads(schema))
        lines = spark.read.format(FORMAT).option("rangebytes", str(range_bytes)).load(local_path(path))
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("row")).select("row.*")

    @staticmethod
    def vacuum(path: str) -> int:
        """Delete parts that no list names, which tasks of failed jobs may have left; how many they were. Not while
        others write to the table."""
        folder = local_path(path)
        named = {p["name"] for p in parts_of(folder)["parts"]} | {LIST}
        stray = [x for x in os.listdir(folder) if x not in named]
        for x in stray:
            os.unlink(f"{folder}/{x}")
        return len(stray)


class JsonManifest:
    """A manifest as one JSON file, replaced in one step, in any store that Spark writes."""

    @staticmethod
    def write(spark: SparkSession, path: str, name: str, body: dict) -> None:
        fs, at = filesystem(spark, f"{path}/{name}")
        new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(body, ensure_ascii=False, sort_keys=True, indent=1, default=str).encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(new, at)

    @staticmethod
    def read(spark: SparkSession, path: str, name: str) -> dict | None:
        fs, at = filesystem(spark, f"{path}/{name}")
        if not fs.exists(at):
            return None
        return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{name}", wholetext=True).collect()))


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _tables(kind: str) -> Registry:
    return Registry(kind, parquet=ParquetStore, local_json=JsonStore)


#: Stores by what they hold and by name.
REPOSITORIES: dict[str, Registry] = {"documents": _tables("document store"), "chunks": _tables("chunk store"), "vectors": _tables("vector store"), "manifest": Registry("manifest store", local_json=JsonManifest)}


def collection(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of a collection that one JSON file holds as an array under `key` (`chunks`, `records`,
    `raw_documents` or `parsed_documents`), to be written to a store. Such a file is read by one task."""
    return spark.read.json(path, multiLine=True).select(F.explode(key).alias("row")).select("row.*")

