"""Context assembly: ranked evidence to token-budgeted segments with exact source ranges and citations.

Hits have (query_id, rank, chunk_id, doc_id, version_id, chunk_index, text) and may have title, section,
source_path, page_start and page_end.

Packing needs no loop. White space takes no budget, a citation prefix such as `[C1] ` takes 3 tokens and an
ellipsis 3, so with t(i) tokens in candidate i the first i that does not fit is where the running sum of
3 + t(i) passes the budget; it is cut after as many tokens as are left, and what follows is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry

PREFIX, ELLIPSIS = 3, 3


#: Estimators of the tokens that a text takes, by name.
ESTIMATORS: Registry = Registry("token estimator", regex=T.budget_tokens)


@dataclass(frozen=True)
class Budget:
    """Token budget of a context and the limits of packing."""

    window: int = 4096
    max_context: int = 1800
    prompt: int = 200
    output: int = 512
    margin: int = 64
    per_document: int = 2
    merge_adjacent: bool = True
    estimator: str = "regex"

    def tokens(self, text: Column) -> Column:
        return ESTIMATORS[self.estimator](text)

    def __post_init__(self):
        if self.static() <= 0 or self.static() < self.max_context:
            raise ValueError(f"the window leaves no room for the context: {self}")

    def static(self) -> int:
        return self.window - self.prompt - self.output - self.margin

    def available(self, question: Column) -> Column:
        left = F.lit(self.static()) - self.tokens(question)
        return F.greatest(F.lit(0), F.least(F.lit(self.max_context), left))


def passthrough(hits: DataFrame) -> DataFrame:
    """Evidence as retrieved: one piece per chunk, over its whole text."""
    return hits.withColumn("evidence_id", F.concat(F.lit("evidence_"), F.col("chunk_id").cast("string"))).withColumns({"range_start": F.lit(0), "range_end": F.length("text")})


TRANSFORMERS: Registry = Registry("evidence transformer", passthrough=passthrough)


def transform_evidence(hits: DataFrame, strategy: str = "passthrough", fail_open: bool = True) -> tuple[DataFrame, bool]:
    """(evidence, degraded): a transformer's output, checked; if it fails and may, that of passing through."""
    try:
        out = TRANSFORMERS[strategy](hits)
        faults = evidence_faults(hits, out).limit(1).collect()
        if faults:
            raise ValueError(f"EVIDENCE_TRANSFORM_FAILED: {faults[0]['fault']}")
        return out, False
    except (ValueError, KeyError, TypeError, RuntimeError):
        if not fail_open:
            raise
        return passthrough(hits), True


def evidence_faults(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, fault): repeated ids, unknown or lost sources, ranks out of order, bad ranges, blanks."""
    key = ["query_id", "chunk_id"]
    source = hits.select(*key, F.length("text").alias("_n"), F.col("rank").alias("_r"))
    joined = evidence.join(source, key, "left")
    def fault(rows, what):
        return rows.select("query_id", F.lit(what).alias("fault"))

    bad = (F.col("range_start") < 0) | (F.col("range_start") >= F.col("range_end")) | (F.col("range_end") > F.col("_n"))
    out = fault(evidence.groupBy("query_id", "evidence_id").count().where("count > 1"), "an evidence id occurs twice")
    out = out.unionByName(fault(joined.where("_n IS NULL"), "an unknown source"))
    out = out.unionByName(fault(source.join(evidence.select(*key), key, "left_anti"), "a source is lost"))
    out = out.unionByName(fault(joined.where(bad), "a range outside its source"))
    return out.unionByName(fault(joined.where(T.is_blank(F.col("text"))), "blank evidence"))


def select_evidence(evidence: DataFrame, per_document: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): without repeated ids and contents, and within the quota per document version;
    dropped has query_id, chunk_id, rank and reason."""
    norm = F.lower(T.squeeze(F.col("text")))
    rows = evidence.withColumn("_id", F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("rank", "chunk_id")))
    rows = rows.withColumn("_text", F.when(F.col("_id") == 1, F.row_number().over(Window.partitionBy("query_id", "_id", norm).orderBy("rank", "chunk_id"))))
    fresh = (F.col("_id") == 1) & (F.col("_text") == 1)
    rows = rows.withColumn("_fresh", fresh)
    rows = rows.withColumn("_quota", F.row_number().over(Window.partitionBy("query_id", "doc_id", "version_id", "_fresh").orderBy("rank", "chunk_id")))
    reason = F.when(F.col("_id") > 1, "duplicate_evidence_id").when(F.col("_text") > 1, "duplicate_content").when(F.col("_quota") > per_document, "document_chunk_quota_exceeded")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("_id", "_text", "_fresh", "_quota", "reason"), rows.where("reason IS NOT NULL").select("query_id", "chunk_id", "rank", "reason")


_FIELDS = ("rank", "chunk_id", "doc_id", "version_id", "chunk_index", "text", "title", "section", "source_path", "page_start", "page_end")


def merge_adjacent(kept: DataFrame) -> DataFrame:
    """(query_id, pos, text, sources): in rank order, a piece that follows the first piece of the candidate
    before it in the same document version joins it. Only the first counts, so at most two join."""
    have = set(kept.columns)
    types = {"rank": "int", "chunk_index": "int", "page_start": "int", "page_end": "int"}
    one = F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _FIELDS])
    rows = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = rows.schema["all"].dataType.simpleString()

    def add(acc, x):
        n = F.size(acc)
        first = F.get(F.get(acc, n - 1), F.lit(0))
        joins = (n > 0) & (first["doc_id"] == x["doc_id"]) & first["version_id"].eqNullSafe(x["version_id"]) & (first["chunk_index"] + 1 == x["chunk_index"])
        grown = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(acc, n - 1), F.array(x))))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(F.concat(acc, F.array(F.array(x))))

    groups = F.aggregate("all", F.array().cast(f"array<{kind}>"), add)
    rows = rows.select("query_id", F.posexplode(groups).alias("pos", "sources"))
    return rows.select("query_id", "pos", F.array_join(F.transform("sources", lambda s: s["text"]), "\n").alias("text"), "sources")


def single(kept: DataFrame) -> DataFrame:
    """Candidates of one piece each."""
    have = set(kept.columns)
    types = {"rank": "int", "chunk_index": "int", "page_start": "int", "page_end": "int"}
    one = F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _FIELDS])
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")) - 1
    return kept.select("query_id", pos.alias("pos"), "text", F.array(one).alias("sources"))


def pack(candidates: DataFrame, queries: DataFrame, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:
    """(segments, dropped): candidates in order until the budget is spent.

    segments: query_id, citation_id, text, sources, token_count (prefix included), is_truncated,
    available_tokens, used_tokens; dropped: query_id, chunk_id, rank, reason.
    """
    rows = candidates.join(queries.select("query_id", budget.available(F.col("query")).alias("available_tokens")), "query_id")
    rows = rows.withColumn("t", budget.tokens(F.col("text")) + PREFIX)
    upto = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("t").over(upto)).withColumn("left", F.col("available_tokens") - (F.col("sum") - F.col("t")))
    # the first that does not fit keeps `left` tokens, less prefix and ellipsis
    keep = F.col("left") - PREFIX - ELLIPSIS
    whole = F.col("sum") <= F.col("available_tokens")
    first_over = ~whole & (F.col("sum") - F.col("t") <= F.col("available_tokens"))
    cut = first_over & (keep >= 1)
    prefix = F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\s*(?:" + T.BUDGET_TOKEN + ")"), F.lit(0))
    text = F.when(whole, F.col("text")).when(cut, F.concat(F.array_join(F.slice(prefix, 1, F.greatest(keep, F.lit(1)).cast("int")), ""), F.lit("...")))
    rows = rows.withColumns({"is_truncated": cut, "shown": text})
    taken = rows.where(whole | cut).select(
        "query_id", F.concat(F.lit("C"), F.col("pos") + 1).alias("citation_id"), "pos", F.col("shown").alias("text"), "sources",
        F.when(F.col("is_truncated"), F.col("left")).otherwise(F.col("t")).cast("int").alias("token_count"), "is_truncated", "available_tokens",
    )
    taken = taken.withColumn("used_tokens", F.sum("token_count").over(Window.partitionBy("query_id")))
    gone = rows.where(~(whole | cut)).select("query_id", F.explode("sources").alias("s")).select("query_id", F.col("s.chunk_id").alias("chunk_id"), F.col("s.rank").alias("rank"), F.lit("context_token_budget_exceeded").alias("reason"))
    return taken, gone


def source_ranges(text: Column, truncated: Column, sources: Column) -> Column:
    """(chunk_id, char_start, char_end) of the shown part of every source. A truncated segment shows the
    start of the joined text; one character joins two sources."""
    shown = F.when(truncated, F.length(text) - 3).otherwise(F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<chunk_id:string,char_start:int,char_end:int>>").alias("out"))

    def add(acc, s):
        n = F.length(s["text"])
        seen = F.least(n, shown - acc["at"])
        one = F.array(F.struct(s["chunk_id"].cast("string").alias("chunk_id"), F.lit(0).alias("char_start"), seen.alias("char_end")))
        return F.struct((acc["at"] + n + 1).alias("at"), F.when(seen > 0, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sources, start, add)["out"]


def citations(segments: DataFrame) -> DataFrame:
    """One row per segment: where it comes from, and its first 180 characters."""
    s = F.col("sources")
    first = s[0]
    return segments.select(
        "query_id", "citation_id", "pos", first["chunk_id"].alias("chunk_id"), first["doc_id"].alias("doc_id"), first["version_id"].alias("version_id"), first["title"].alias("title"),
        first["source_path"].alias("source_path"), F.substring("text", 1, 180).alias("snippet"), F.array_min(F.transform(s, lambda x: x["page_start"])).alias("page_start"), F.array_max(F.transform(s, lambda x: x["page_end"])).alias("page_end"),
        first["section"].alias("section"), F.array_distinct(F.array_compact(F.transform(s, lambda x: x["section"]))).alias("sections"), source_ranges(F.col("text"), F.col("is_truncated"), s).alias("source_ranges"),
    )


@dataclass
class Packed:
    """Contexts of all queries."""

    segments: DataFrame
    citations: DataFrame
    dropped: DataFrame
    estimator: str = "regex"

    def texts(self, queries: DataFrame) -> DataFrame:
        """(query_id, context_text, used_tokens, available_tokens, remaining_tokens, estimator)."""
        parts = F.array_sort(F.collect_list(F.struct("pos", "citation_id", "text")))
        per = self.segments.groupBy("query_id").agg(
            F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p["citation_id"], F.lit("] "), p["text"])), "\n\n").alias("context_text"), F.max("used_tokens").alias("used_tokens"), F.max("available_tokens").alias("available_tokens")
        )
        zero = F.lit(0)
        return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("context_text", F.lit("")).alias("context_text"), F.coalesce("used_tokens", zero).alias("used_tokens"), "available_tokens", (F.col("available_tokens") - F.coalesce("used_tokens", zero)).alias("remaining_tokens"), F.lit(self.estimator).alias("estimator"))


def assemble(hits: DataFrame, queries: DataFrame, budget: Budget = Budget(), strategy: str = "passthrough") -> Packed:
    """The whole way from hits to packed contexts."""
    evidence, _ = transform_evidence(hits, strategy)
    kept, dropped = select_evidence(evidence, budget.per_document)
    segments, over = pack(merge_adjacent(kept) if budget.merge_adjacent else single(kept), queries, budget)
    return Packed(segments, citations(segments), dropped.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(over), budget.estimator)
