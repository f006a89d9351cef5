"""Embedding: hash vectors, validation, and a cache table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry

MODEL, DIMENSION = "mock-hash-embedding", 16


def hash_vector(text: str, model: str = MODEL, dimension: int = DIMENSION) -> list[float]:
    """A deterministic unit vector: BLAKE2b digests of model, round and text, bytes centred and scaled."""
    rounds = range(-(-dimension // 64))
    data = b"".join(hashlib.blake2b(f"{model}|{i}|{text}".encode(), digest_size=min(64, dimension - 64 * i)).digest() for i in rounds)
    v = (np.frombuffer(data, dtype=np.uint8).astype(float) - 128) / 128
    size = float(np.sqrt((v * v).sum()))
    return (v / size if size else v).tolist()


def hash_embedding(model: str = MODEL, dimension: int = DIMENSION):
    """Column of texts to column of vectors. Spark has no BLAKE2b; batches cross over as Arrow."""
    if dimension <= 0:
        raise ValueError("a vector needs a positive dimension")

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hash_vector(t, model, dimension))

    return embed


EMBEDDERS: Registry = Registry("embedder", mock=hash_embedding)


def valid_vector(v: Column, dimension: int) -> Column:
    """Right length and finite in every place."""
    return (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def with_cache(rows: DataFrame, cache: DataFrame, provider: str = "mock", model: str = MODEL, dimension: int = DIMENSION) -> DataFrame:
    """Rows (…, text) with vector and cache_hit. Texts not in `cache` (provider, model_name, dimension,
    text_hash, vector) are embedded; equal new texts are all misses, since the look-up comes first."""
    keyed = rows.withColumn("text_hash", F.sha2("text", 256))
    own = cache.where((F.col("provider") == provider) & (F.col("model_name") == model) & (F.col("dimension") == dimension)).select("text_hash", F.col("vector").alias("cached"))
    joined = keyed.join(own.dropDuplicates(["text_hash"]), "text_hash", "left")
    hits = joined.where("cached IS NOT NULL").withColumn("vector", F.col("cached")).withColumn("cache_hit", F.lit(True))
    misses = joined.where("cached IS NULL").withColumn("vector", EMBEDDERS[provider](model, dimension)("text")).withColumn("cache_hit", F.lit(False))
    return hits.unionByName(misses).drop("cached")


def new_cache_rows(embedded: DataFrame, provider: str = "mock", model: str = MODEL, dimension: int = DIMENSION) -> DataFrame:
    """What a run adds to the cache."""
    rows = embedded.where("NOT cache_hit").dropDuplicates(["text_hash"])
    return rows.select(F.lit(provider).alias("provider"), F.lit(model).alias("model_name"), F.lit(dimension).alias("dimension"), "text_hash", "vector")


def without_blank(chunks: DataFrame, fail: bool = True) -> DataFrame:
    """Chunks with text. With `fail`, a blank chunk ends the query when it is met."""
    blank = T.is_blank(F.col("text"))
    if fail:
        return chunks.where(F.when(blank, F.raise_error(F.lit("INDEX_FAILED: a chunk is blank")).cast("boolean")).otherwise(True))
    return chunks.where(~blank)
