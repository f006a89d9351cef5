"""Suffix-array deduplication over bytes.

The suffixes that can start a repeat of `min_bytes` bytes are sorted by their leading bytes: sampled
splitters range-partition them, every bucket sorts locally by multikey quicksort, and neighbours are
compared, across bucket boundaries too. Beyond its eight leading bytes a suffix is ordered by digests of
the bytes that follow, which keeps a row at forty bytes; equal suffixes still end up side by side, which
is all that the search for repeats takes from the order.

Suffixes are pruned exactly before they are exchanged (see `_repeats`): first one per winnowed anchor,
then one per block of eight starts where whole zones differ, then single starts. Sorting one row for every
byte of the input would exchange some thirty times the input.

Defined results: null counts as empty; a text shorter than the threshold is never cut; matches never
cross documents; repeated rows are repeats of each other; rows with one id but different texts stay
apart; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import merged, repeats
from ._spark import ROW, arrow_map, real_id, same_row, text_bytes

MIN_BYTES = 200
SEED_BYTES = 40
BLOCK = 8


def _base_extra(texts, units):
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]


def _cut(min_bytes: int):
    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            kept, removed, spans = [], [], []
            for i, t in enumerate(texts):
                part = b.column("parts")[i].values
                lo, hi = merged(part.field("at").to_numpy(), part.field("n").to_numpy(), min_bytes)
                keep, at = [], 0
                for x, y in zip(lo.tolist(), hi.tolist()):
                    keep.append(t[at:x])
                    at = y
                keep.append(t[at:])
                kept.append(b"".join(keep))
                removed.append(int((hi - lo).sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "mark", "kept", "n_removed", "spans"],
            )

    return run


class SuffixDedup:
    """found: (doc_id, mark, kept, n_removed, spans) of the documents that lose bytes: spans are disjoint
    byte ranges, kept the remaining bytes; rows are keyed by (doc_id, mark), see `_spark.row_key`. base: (doc_id, mark, n_bytes, text_sha256) of every row."""

    def __init__(self, docs: DataFrame, *, min_bytes: int = MIN_BYTES, seed_bytes: int = SEED_BYTES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"):
        self.base, found = repeats(
            docs, unit="byte", length=min_bytes, seed=min(seed_bytes, min_bytes), blocks=[block, 1] if min_bytes >= 2 * block else [1], by_lead=True, id_col=id_col, text_col=text_col,
            extra=_base_extra, extra_schema="n_bytes long, text_sha256 string",
        )
        self.found = arrow_map(found, _cut(min_bytes), f"{ROW}, kept binary, n_removed long, spans array<struct<start:bigint,end:bigint>>")

    def digests(self) -> DataFrame:
        """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
        base = self.base.select("doc_id", "mark", "n_bytes", "text_sha256")
        cut = self.found.select("doc_id", "mark", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")).dropDuplicates(["doc_id", "mark"])
        zero = F.lit(0).cast("long")
        return base.join(cut, same_row(base, cut), "left").select(
            real_id(base["doc_id"], base["mark"]).alias("doc_id"), base["n_bytes"], F.coalesce(cut["n_removed"], zero).alias("n_removed"), F.coalesce(cut["n_spans"], zero).alias("n_spans"), F.coalesce(cut["sha"], base["text_sha256"]).alias("kept_sha256")
        )


def suffix_dedup(docs: DataFrame, **options) -> SuffixDedup:
    return SuffixDedup(docs, **options)
