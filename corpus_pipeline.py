"""From raw documents to a tokenised training mix, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps; all but the last return the columns
of `documents`. A stage's rows are written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.llm._spark import drop, kept
from loresift.llm.bpe import encode
from loresift.llm.jaccard import near_roots
from loresift.llm.langid import keep_identified
from loresift.llm.mixing import mixed
from loresift.llm.simhash import keep_first
from loresift.llm.substring import substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters, or that fit none, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingles are alike by 0.8 or more (Jaccard)."""
    return keep_first(docs, near_roots(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that occur elsewhere too; n_chars follows."""
    out = substring_dedup(docs).texts()
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document once for every time that it is taken."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids."""
    return encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: No stage but the mix can be said in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, kept(stage(spark, docs, sf_dir), name)
        drop(*([before] if hasattr(before, "_kept_at") else []))  # a stage's rows are read by the next one only
    return STAGES[-1][1](spark, docs, sf_dir)
