"""Gold sets: evaluation cases from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = (
    "id string, question string, question_type string, expected_doc_ids array<string>, expected_chunk_ids array<string>, expected_source_paths array<string>, "
    "expected_keywords array<string>, answer_notes string, expected_abstention boolean, tags array<string>, split string"
)


class GoldSetError(ValueError):
    """A gold set that can't be used, with path and line where there is one."""


def load(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Cases in file order (line_no). Blank lines and lines that start with # are passed over; a line that
    is no JSON object, lacks a required field or repeats an id is an error, as is an empty set."""
    # a gold set is one file and its lines are its order: it is read as one row and split
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).select((F.col("i") + 1).alias("line_no"), T.strip(F.col("line")).alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.select("line_no", F.from_json("line", SCHEMA).alias("c"))
    blank = lambda c: F.col(c).isNull() | (T.strip(F.col(c)) == "")
    bad = rows.where(F.col("c").isNull() | blank("c.id") | blank("c.question") | blank("c.question_type")).select("line_no").orderBy("line_no").head()
    if bad:
        raise GoldSetError(f"{path}:{bad['line_no']}: not a case")
    twice = rows.groupBy(T.strip(F.col("c.id")).alias("id")).agg(F.count("*").alias("n"), F.max("line_no").alias("line_no")).where("n > 1").orderBy("line_no").head()
    if twice:
        raise GoldSetError(f"{path}:{twice['line_no']}: the id {twice['id']} occurs twice")
    if rows.isEmpty():
        raise GoldSetError(f"{path}: no case")
    values = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(f"c.{c}"), F.array().cast("array<string>")), T.strip), lambda x: x != "")).alias(c)
    out = rows.select(
        "line_no", T.strip(F.col("c.id")).alias("query_id"), T.strip(F.col("c.question")).alias("query"), T.strip(F.col("c.question_type")).alias("question_type"), *[values(c) for c in ("expected_doc_ids", "expected_chunk_ids", "expected_source_paths", "expected_keywords", "tags")],
        T.strip(F.coalesce("c.answer_notes", F.lit(""))).alias("answer_notes"), F.coalesce("c.expected_abstention", F.lit(False)).alias("expected_abstention"), F.coalesce(F.when(~blank("c.split"), T.strip(F.col("c.split"))), F.lit("development")).alias("split"),
    )
    return out.orderBy("line_no").limit(limit) if limit is not None else out
