"""Substring deduplication over words: seed and extend.

Every window of `min_words` words owns a winnowed anchor, its smallest hash among runs of `seed_words`
words. Documents are joined on equal anchors, and each match is extended both ways, word by word, into a
maximal repeat; those of at least `min_words` words stay, and the words they cover are cut from every
occurrence, the first included. Occurrences that agree as far as their windows reach are settled at once by
digests; where more than a bounded number of different ones share an anchor (a frequent phrase), the windows
around it are sorted instead of being compared with each other, so that no group grows with its square.

Defined results: null and empty texts have no words; a text shorter than the threshold is never cut;
repeated rows are repeats of each other; rows with one id but different texts stay apart; an empty table
gives an empty result; columns other than the id and the text are not looked at. A document is held whole
by one worker; nothing else is, whatever the number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import merged, repeats
from ._spark import ROW, arrow_map, real_id, row_key, same_row, text_bytes

MIN_WORDS = 35
SEED_WORDS = 8


def _base_extra(texts, units):
    words = [t.split() for t in texts]
    return [pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])]


def _cut(min_words: int):
    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            kept_text, removed, spans = [], [], []
            for i, t in enumerate(texts):
                words, part = t.split(), b.column("parts")[i].values
                lo, hi = merged(part.field("at").to_numpy(), part.field("n").to_numpy(), min_words)
                keep, at = [], 0
                for x, y in zip(lo.tolist(), hi.tolist()):
                    keep += words[at:x]
                    at = y
                keep += words[at:]
                kept_text.append(b" ".join(keep).decode())
                removed.append(int((hi - lo).sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(kept_text, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "mark", "kept", "n_removed", "spans"],
            )

    return run


class SubstringDedup:
    """Result of the search over one table.

    Rows are keyed by (doc_id, mark), see `_spark.row_key`. found: (doc_id, mark, kept, n_removed, spans) of the documents that lose words; spans are disjoint
    word ranges, kept is the remaining words joined by one space. base: (doc_id, mark, n_words,
    words_sha256) of every row, the digest being that of all its words.
    """

    def __init__(self, docs: DataFrame, *, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.base, found = repeats(
            docs, unit="word", length=min_words, seed=min(seed_words, min_words), blocks=[1], by_lead=False, id_col=id_col, text_col=text_col,
            extra=_base_extra, extra_schema="n_words long, words_sha256 string",
        )
        self.found = arrow_map(found, _cut(min_words), f"{ROW}, kept string, n_removed long, spans array<struct<start:bigint,end:bigint>>")

    def digests(self) -> DataFrame:
        """Per row: doc_id, n_words, n_removed, kept_sha256."""
        base = self.base.select("doc_id", "mark", "n_words", "words_sha256")
        cut = self.found.select("doc_id", "mark", "n_removed", F.sha2("kept", 256).alias("sha")).dropDuplicates(["doc_id", "mark"])
        return base.join(cut, same_row(base, cut), "left").select(
            real_id(base["doc_id"], base["mark"]).alias("doc_id"), base["n_words"], F.coalesce(cut["n_removed"], F.lit(0).cast("long")).alias("n_removed"), F.coalesce(cut["sha"], base["words_sha256"]).alias("kept_sha256")
        )

    def texts(self) -> DataFrame:
        """The rows of the table with their texts cut; rows that lose every word go, texts without a
        repeat stay as they were."""
        docs, cut = self.docs, self.found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "kept").dropDuplicates(["_id", "_mark"])
        text = docs[self.text_col]
        doc_id, mark = row_key(docs[self.id_col], text)
        joined = docs.join(cut, (doc_id == cut["_id"]) & (mark == cut["_mark"]), "left")
        now = F.coalesce(cut["kept"], text).alias(self.text_col)
        return joined.where(cut["kept"].isNull() | (cut["kept"] != "")).select(*[now if c == self.text_col else docs[c] for c in docs.columns])


def substring_dedup(docs: DataFrame, **options) -> SubstringDedup:
    return SubstringDedup(docs, **options)
