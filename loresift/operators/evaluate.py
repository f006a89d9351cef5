"""Evaluation of a batch of answered cases against expected evidence.

Cases have (query_id, question_type, expected_chunk_ids, expected_doc_ids, expected_source_paths,
expected_abstention); the first non-empty expectation decides by what evidence is matched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FAILURE
from ..functions import text as T

METRICS = (
    "retrieval_hit_rate", "retrieval_recall", "retrieval_mrr", "retrieval_precision", "context_recall", "context_precision",
    "citation_coverage", "answer_has_citation_ratio", "abstention_accuracy",
)


def expectations(cases: DataFrame) -> DataFrame:
    """Cases with `identity` (chunk, document, source or none) and `expected`, distinct ids as text."""
    have = set(cases.columns)
    none = F.array().cast("array<string>")
    col = lambda c: F.coalesce(F.col(c).cast("array<string>"), none) if c in have else none
    chunk, doc, path = col("expected_chunk_ids"), col("expected_doc_ids"), F.transform(col("expected_source_paths"), T.posix_path)
    pick = lambda a, b, c, d: F.when(F.size(chunk) > 0, a).when(F.size(doc) > 0, b).when(F.size(path) > 0, c).otherwise(d)
    return cases.withColumns({"identity": pick(F.lit("chunk"), F.lit("document"), F.lit("source"), F.lit("none")), "expected": F.array_distinct(pick(chunk, doc, path, none))})


def identity_of(identity: Column, have: set[str]) -> Column:
    """What a row of hits, context or citations is matched by."""
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    return F.when(identity == "chunk", col("chunk_id")).when(identity == "document", col("doc_id")).when(identity == "source", T.posix_path(col("source_path")))


def _gathered(cases: DataFrame, rows: DataFrame, order: str, name: str) -> DataFrame:
    own = rows.join(cases.select("query_id", "identity"), "query_id")
    return own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), identity_of(F.col("identity"), set(rows.columns)).alias("i")))), lambda x: x["i"]).alias(name))


# What a review rates.
REVIEWED = ("answer_relevance", "faithfulness", "groundedness", "citation_correctness")


def case_metrics(cases: DataFrame, hits: DataFrame, context: DataFrame, cited: DataFrame, answered: DataFrame) -> DataFrame:
    """The nine metrics of every case: hits by rank, context and cited sources by pos, answers by status.
    Metrics of evidence are null where none is expected."""
    rows = expectations(cases)
    none = F.array().cast("array<string>")
    for frame, order, name in ((hits, "rank", "got"), (context, "pos", "used"), (cited, "n", "cited")):
        rows = rows.join(_gathered(expectations(cases), frame, order, name), "query_id", "left").withColumn(name, F.coalesce(name, none))
    why = F.col("fault") if "fault" in answered.columns else F.lit(None).cast("string")
    rows = rows.join(answered.select("query_id", "status", why.alias("fault")), "query_id", "left")
    fault = F.coalesce("fault", F.lit("GENERATION_FAILED: no answer"))
    code = F.substring_index(fault, ":", 1)
    expected, got = F.col("expected"), F.col("got")
    n = F.size(expected)
    common = lambda c: F.size(F.array_intersect(F.array_distinct(c), expected))
    matched = F.filter(got, lambda x: F.array_contains(expected, x))
    first = F.aggregate(F.transform(got, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    some = lambda v: F.when(n > 0, v.cast("double"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    talks = F.col("status") == "answered"
    return rows.select(
        "query_id", "question_type",
        some((F.size(matched) > 0).cast("int")).alias("retrieval_hit_rate"),
        some(F.size(F.array_distinct(matched)) / n).alias("retrieval_recall"),
        some(F.coalesce(1.0 / first, F.lit(0.0))).alias("retrieval_mrr"),
        some(ratio(F.size(matched), F.size(got))).alias("retrieval_precision"),
        some(common(F.col("used")) / n).alias("context_recall"),
        some(ratio(common(F.col("used")), F.size(F.array_distinct("used")))).alias("context_precision"),
        some(common(F.col("cited")) / n).alias("citation_coverage"),
        F.when(talks, (F.size("cited") > 0).cast("double")).alias("answer_has_citation_ratio"),
        (F.when(F.col("expected_abstention"), ~talks).otherwise(talks)).cast("double").alias("abstention_accuracy"),
        F.when(F.col("status") == "failed", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.col("status") == "failed", F.struct(F.lower(code).alias("failure_type"), code.alias("error_code"), fault.alias("message"))).cast(FAILURE).alias("failure"),
    )


def failed_cases(cases: DataFrame, failure: Column) -> DataFrame:
    """Rows of `case_metrics` for cases that could not be answered: no metric, and why."""
    none = F.lit(None).cast("double")
    return cases.select("query_id", "question_type", *[none.alias(m) for m in METRICS], F.lit("error").alias("status"), failure.cast(FAILURE).alias("failure"))


def isolated(metrics: DataFrame, cases: DataFrame, faults: DataFrame | None) -> DataFrame:
    """Case metrics in which the cases with faults (query_id, failure) fail, each on its own."""
    if faults is None:
        return metrics
    bad = failed_cases(cases.join(faults, "query_id"), F.col("failure"))
    return metrics.join(faults.select("query_id"), "query_id", "left_anti").unionByName(bad)


def summary(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over the cases that succeeded, nulls left out: overall (question_type null) and
    by question type, with the number of values; of each experiment on its own, where there are some."""
    ok = metrics.where("status = 'success'")
    own = ["experiment"] if "experiment" in metrics.columns else []
    stack = ", ".join(f"'{m}', `{m}`" for m in METRICS)
    long = ok.selectExpr(*own, "question_type", f"stack({len(METRICS)}, {stack}) AS (metric, value)")
    sets = [[*own, "metric"], [*own, "metric", "question_type"]]
    return long.groupingSets(sets, *own, "metric", "question_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def counts(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("error"))


def suite(experiments: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Case metrics of several experiments, told apart by `experiment`."""
    return reduce(DataFrame.unionByName, [f().withColumn("experiment", F.lit(n)) for n, f in experiments.items()])


def failure_counts(metrics: DataFrame) -> DataFrame:
    """(failure_type, n) of the cases that failed."""
    return metrics.where("status <> 'success'").groupBy(F.col("failure.failure_type").alias("failure_type")).agg(F.count("*").alias("n"))


def with_review(metrics: DataFrame) -> DataFrame:
    """Case metrics with an empty `review`, to be filled by people or a later judge, apart from what is
    measured."""
    scores = ", ".join(f"{x}: double" for x in REVIEWED)
    return metrics.withColumn("review", F.lit(None).cast(f"struct<{scores}, failure_type: string, notes: string>"))
