"""Query planning: passing through, expansion by rules, and checked model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry

# Trigger terms and the aliases they add, in order.
ALIASES = {
    "重排序": ["reranking", "reranker"],
    "精排": ["reranking", "reranker"],
    "两阶段": ["two-stage retrieval", "candidate retrieval"],
    "混合检索": ["hybrid retrieval", "dense sparse retrieval"],
    "向量检索": ["dense retrieval", "embedding similarity"],
    "关键词检索": ["BM25", "sparse retrieval"],
    "引用": ["citation", "grounded answer"],
    "幻觉": ["hallucination", "groundedness"],
    "上下文": ["context packing", "token budget"],
}


def distinct_values(values: Column, primary: Column) -> Column:
    """Stripped values without blanks, repeats and the primary query."""
    return F.array_except(F.array_distinct(F.filter(F.transform(values, T.squeeze), lambda x: x != "")), F.array(primary))


def passthrough(queries: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    text = T.squeeze(F.col("query"))
    return queries.select("query_id", text.alias("original_query"), text.alias("primary_query"), none.alias("additional_queries"), none.alias("keywords"), F.lit("passthrough").alias("strategy"))


def rule_based(queries: DataFrame, max_additional: int = 0, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Append the aliases of the terms in a question that it does not have yet; the first of them may be
    searched for on their own too."""
    text = T.squeeze(F.col("query"))
    rows = queries.select("query_id", text.alias("original_query"))
    said = F.lower(F.col("original_query"))
    found = [F.when(F.col("original_query").contains(term) & ~said.contains(a.lower()), F.lit(a)) for term, names in aliases.items() for a in names]
    keywords = F.array_distinct(F.array_compact(F.array(*found)))
    rows = rows.withColumn("keywords", keywords)
    primary = F.trim(F.concat_ws(" ", "original_query", "keywords"))
    return rows.select("query_id", "original_query", primary.alias("primary_query"), F.slice("keywords", 1, max_additional).alias("additional_queries") if max_additional else F.array().cast("array<string>").alias("additional_queries"), "keywords", F.lit("rule_based").alias("strategy"))


PAYLOAD = "primary_query string, additional_queries array<string>, keywords array<string>, hyde_document string"


def from_model(queries: DataFrame, max_additional: int = 2) -> DataFrame:
    """Plans from model output in `payload` (JSON); where it can't be read, the question itself, marked as
    a fallback."""
    p = F.from_json("payload", PAYLOAD)
    text = T.squeeze(F.col("query"))
    rows = queries.select("query_id", text.alias("original_query"), p.alias("p"))
    primary = T.squeeze(F.col("p.primary_query"))
    good = F.coalesce(primary != "", F.lit(False))
    none = F.array().cast("array<string>")
    main = F.when(good, primary).otherwise(F.col("original_query"))
    more = F.when(good & F.col("p.additional_queries").isNotNull(), F.slice(distinct_values(F.col("p.additional_queries"), primary), 1, max_additional)).otherwise(none)
    keys = F.when(good & F.col("p.keywords").isNotNull(), distinct_values(F.col("p.keywords"), F.lit(""))).otherwise(none)
    return rows.select("query_id", "original_query", main.alias("primary_query"), more.alias("additional_queries"), keys.alias("keywords"), F.when(good, "llm").otherwise("passthrough").alias("strategy"), (~good).alias("fallback_used"))


PLANNERS: Registry = Registry("query planner", passthrough=passthrough, rule_based=rule_based, llm=from_model)


def retrieval_queries(plans: DataFrame) -> DataFrame:
    """(query_id, query_pos, query): the primary query first, then the additional ones."""
    rows = plans.select("query_id", F.posexplode(F.concat(F.array("primary_query"), "additional_queries")).alias("query_pos", "query"))
    return rows.where(~T.is_blank(F.col("query")))
