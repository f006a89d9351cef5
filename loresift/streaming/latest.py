"""Streams of document changes: keyed state keeps the version and hash of every document, so that of repeated, late
and changed files only what is new goes on, also after a restart.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import chunk as C
from ..operators import segments as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _digest(text: str | None, deleted: bool) -> str:
    return "deleted" if deleted or text is None else hashlib.sha256(text.encode()).hexdigest()


class _Latest(StatefulProcessor):
    """Lets a change pass if its version is above the one kept and its content is another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "version long, digest string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (Spark's names)
        version, digest = self.kept.get() if self.kept.exists() else (None, None)
        new = None
        for b in rows:
            for v, text, gone in zip(b["version"], b["text"], b["deleted"]):
                gone, text = bool(gone) if not pd.isna(gone) else False, None if text is None or text != text else text
                own = _digest(text, gone)
                if pd.isna(v) or (version is not None and (v, own) <= (version, digest if v == version else "")):
                    continue  # late, or seen
                changed = own != digest
                version, digest = int(v), own
                new = (int(v), text, gone) if changed else new and (int(v), *new[1:])
        if version is not None:
            self.kept.update((version, digest))
        if new is not None:
            yield pd.DataFrame({"doc_id": [key[0]], "version": [new[0]], "text": [new[1]], "deleted": [new[2]]})

    def close(self) -> None:
        pass


def latest_changes(stream: DataFrame) -> DataFrame:
    """A stream of (doc_id, version, text, deleted) without what is repeated, late or unchanged."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS string) AS doc_id", "CAST(version AS long) AS version", "text", "deleted")
    return rows.groupBy("doc_id").transformWithStateInPandas(_Latest(), S.CHANGE, "Update", "None")


def follow(stream: DataFrame, path: str, checkpoint: str, config: C.Chunking = C.Chunking(), compact_at: int = 16) -> StreamingQuery:
    """Keep the segments under `path` up to date with a stream of changes: a segment a batch, and a compaction when
    there are `compact_at` of them. A batch that runs again is known by its number."""

    def batch(df: DataFrame, n: int) -> None:
        if not df.isEmpty():
            S.apply(df, path, f"batch-{n}", config)
        if len(S.manifest(df.sparkSession, path)["segments"]) >= compact_at:
            S.compact(df.sparkSession, path)

    return latest_changes(stream).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
