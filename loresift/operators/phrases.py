"""Positional postings: where each term stands in each chunk, and exact phrase search over that.

A phrase is found by its rarest term. Only the chunks that hold that term are looked at further: the other terms'
postings of those chunks must hold the places that the phrase then needs. Texts are not read. Postings of the phrases'
terms are shuffled once, by chunk; a group is what one chunk holds of those terms.

Phrases are sequences of search tokens, so case, punctuation and white space between them do not matter. A phrase
without a token is found nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import batched
from .retrieve import TOKENIZERS, bounded


def positional_index(chunks: DataFrame, tokenizer: str = "regex", phrases: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, tf, positions) of (chunk_id, text): the places of a term, counted in tokens from 0; for given
    phrases of their terms only. A chunk's places are grouped in the batch that holds it, so nothing is shuffled."""
    tokens = chunks.select("chunk_id", TOKENIZERS[tokenizer](F.col("text")).alias("tokens"))

    def run(batches):
        for b in batches:
            lists = b.column("tokens").combine_chunks() if isinstance(b.column("tokens"), pa.ChunkedArray) else b.column("tokens")
            sizes = np.diff(lists.offsets.to_numpy())
            if not sizes.sum():
                continue
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(row * len(flat.dictionary) + codes, kind="stable")  # places stay in order
            row, codes, place = row[order], codes[order], place[order]
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])]))
            ends = np.append(cut, len(codes)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(codes[cut])), b.column("chunk_id").take(pa.array(row[cut])), pa.array(np.diff(ends)), places], names=["term", "chunk_id", "tf", "positions"])

    out = batched(tokens, run, f"term string, chunk_id {dict(chunks.dtypes)['chunk_id']}, tf int, positions array<int>")
    return out if phrases is None else out.join(bounded(phrase_tokens(phrases, tokenizer).select("term").distinct()), "term", "left_semi")


def write(positions: DataFrame, path: str) -> None:
    """Laid out by term and chunk, so that a phrase reads only the files its terms are in."""
    positions.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(path)


def phrase_tokens(phrases: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """(query_id, at, term, size) of (query_id, query)."""
    tokens = TOKENIZERS[tokenizer](F.col("query"))
    return phrases.select("query_id", F.size(tokens).alias("size"), F.posexplode(tokens).alias("at", "term"))


def phrase_search(positions: DataFrame, phrases: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """(query_id, chunk_id, occurrences, first): the chunks that hold each phrase, how often, and the place of its
    first token there."""
    tokens = phrase_tokens(phrases, tokenizer)
    # the rarest term of each phrase, by the number of chunks that hold it; terms that no chunk holds are rarest
    df = positions.join(bounded(tokens.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = tokens.join(df, "term", "left").groupBy("query_id", "size").agg(F.min_by(F.struct("term", "at"), F.struct(F.coalesce("df", F.lit(0)), "at")).alias("r"))
    rarest = rarest.select("query_id", "size", F.col("r.term").alias("term"), F.col("r.at").alias("at"))
    starts = positions.join(bounded(rarest), "term").select("query_id", "chunk_id", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    alone, several = starts.join(bounded(rarest.where("size = 1").select("query_id")), "query_id", "left_semi"), bounded(tokens.where("size > 1").groupBy("query_id").agg(F.collect_list(F.struct("at", "term")).alias("tokens")))
    # what a chunk holds of the phrases' terms comes together once; a start is good if every token stands where it needs it
    held = positions.join(bounded(tokens.where("size > 1").select("term").distinct()), "term", "left_semi").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "positions")).alias("held"))
    met = starts.withColumn("starts", F.filter("starts", lambda s: s >= 0)).where(F.size("starts") > 0).join(held, "chunk_id").join(several, "query_id")
    met = met.where(F.size(F.array_except(F.transform("tokens", lambda t: t["term"]), F.transform("held", lambda h: h["term"]))) == 0)
    stands = lambda s, t: F.exists("held", lambda h: (h["term"] == t["term"]) & F.array_contains(h["positions"], s + t["at"]))
    good = met.select("query_id", "chunk_id", F.filter("starts", lambda s: F.forall("tokens", lambda t: stands(s, t))).alias("starts"))
    found = good.unionByName(alone).where(F.size("starts") > 0)
    return found.select("query_id", "chunk_id", F.size("starts").cast("long").alias("occurrences"), F.array_min("starts").alias("first"))
