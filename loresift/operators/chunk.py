"""Chunking: documents or blocks to overlapping windows of characters or tokens.

Documents have (doc_id, version_id, content_hash, source_path, title, text, metadata); only doc_id and text
are needed. Chunks get chunk_index, chunk_id, token_count, char_start, char_end and what they carry over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry


@dataclass(frozen=True)
class Chunking:
    """Window size and overlap, in characters or tokens, and how chunk length is measured."""

    size: int = 600
    overlap: int = 100
    tokenizer: str = "char_approx"

    def __post_init__(self):
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError(f"the overlap must be smaller than the size: {self}")
        if self.tokenizer not in ("char_approx", "simple_regex"):
            raise ValueError(f"unknown tokenizer {self.tokenizer}")


def char_windows(text: Column, config: Chunking) -> Column:
    """Stripped windows (text, start, end) at every step up to the end of the text, blank ones left out."""
    n, step = F.length(text), config.size - config.overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def window(at):
        raw = text.substr(at + 1, F.lit(config.size))
        bare = T.strip(raw)
        start = at + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
        return F.struct(bare.alias("text"), start.alias("start"), (start + F.length(bare)).alias("end"))

    return F.filter(F.transform(starts, window), lambda w: w["text"] != "")


def token_windows(text: Column, config: Chunking) -> Column:
    """Windows (text, start, end, token_start, token_end) over the chunk tokens; the last window ends with
    the last token. Places are summed up from window to window, so the cost stays linear."""
    step = config.size - config.overlap

    def over(pieces):
        n = F.size(pieces)
        count = F.when(n == 0, 0).when(n <= config.size, 1).otherwise(F.ceil((n - config.size) / step).cast("int") + 1)
        numbers = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def advance(acc, i):
            return F.struct((acc["at"] + F.length(F.array_join(F.slice(pieces, i * step + 1, F.lit(step)), ""))).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

        def cut(starts):
            def window(i):
                first, last = i * step, F.least(i * step + config.size, n)
                raw = F.array_join(F.slice(pieces, first + 1, last - first), "")
                bare = F.regexp_replace(raw, r"(?U)^\s+", "")
                end = F.element_at(starts, i + 1) + F.length(raw)
                return F.struct(bare.alias("text"), (end - F.length(bare)).alias("start"), end.alias("end"), first.alias("token_start"), last.alias("token_end"))

            return F.transform(numbers, window)

        return F.flatten(F.transform(F.array(F.aggregate(numbers, begin, advance)["starts"]), cut))

    # arrays of one bind what is worked out once to a name
    return F.flatten(F.transform(F.array(T.spaced_chunk_tokens(text)), over))


def _finish(rows: DataFrame, config: Chunking, strategy: str, index: Column) -> DataFrame:
    """Number the chunks and give them identity, length and metadata."""
    have = set(rows.columns)
    rows = rows.withColumn("chunk_index", index).withColumn("token_count", T.token_count(F.col("text"), config.tokenizer))
    version = F.col("version_id") if "version_id" in have else F.col("doc_id").cast("string")
    rows = rows.withColumn("chunk_id", T.part_id("chunk", version, F.col("chunk_index"), F.col("text")))
    contract = {"chunking_strategy": F.lit(strategy), "chunk_size": F.lit(config.size), "chunk_overlap": F.lit(config.overlap), "tokenizer": F.lit(config.tokenizer)}
    contract |= {c: F.col(c) for c in ("char_start", "char_end", "section", "token_start", "token_end", "section_block_count") if c in have}
    pairs = F.map_filter(F.create_map(*[x for k, v in contract.items() for x in (F.lit("section_title" if k == "section" else k), v.cast("string"))]), lambda _, v: v.isNotNull())
    if "metadata" in have:  # later maps win
        pairs = F.map_concat(F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys(pairs), k)), pairs)
    return rows.withColumn("metadata", pairs)


def _carried(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "version_id", "content_hash", "source_path", "title", "metadata") if c in docs.columns]


def character(docs: DataFrame, config: Chunking = Chunking(), blocks: DataFrame | None = None) -> DataFrame:
    """Character windows over whole documents."""
    rows = docs.select(*_carried(docs), F.posexplode(char_windows(F.col("text"), config)).alias("n", "w"))
    rows = rows.select(*_carried(docs), "n", "w.text", F.col("w.start").alias("char_start"), F.col("w.end").alias("char_end"))
    return _finish(rows, config, "character", F.col("n")).drop("n")


def fixed_token(docs: DataFrame, config: Chunking = Chunking(), blocks: DataFrame | None = None) -> DataFrame:
    """Windows of a fixed number of tokens over whole documents."""
    rows = docs.select(*_carried(docs), F.posexplode(token_windows(F.col("text"), config)).alias("n", "w"))
    rows = rows.select(*_carried(docs), "n", "w.text", F.col("w.start").alias("char_start"), F.col("w.end").alias("char_end"), F.col("w.token_start"), F.col("w.token_end"))
    return _finish(rows, config, "fixed_token", F.col("n")).drop("n")


def section_groups(blocks: DataFrame) -> DataFrame:
    """Runs of consecutive blocks of one section: (doc_id, version_id, section_no, section, text, pages,
    char_start, section_block_count). An empty section counts as none and the one before goes on."""
    order = Window.partitionBy("doc_id", "version_id").orderBy("block_index")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = F.when(F.col("section") != "", F.col("section"))
    rows = blocks.withColumn("s", F.last(said, ignorenulls=True).over(upto))
    rows = rows.withColumn("new", (F.row_number().over(order) == 1) | ~F.col("s").eqNullSafe(F.lag("s").over(order)))
    rows = rows.withColumn("section_no", F.sum(F.col("new").cast("int")).over(upto))
    parts = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return rows.groupBy("doc_id", "version_id", "section_no").agg(
        F.first("s").alias("section"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min("char_start").alias("first_char"),
        F.count("*").alias("section_block_count"),
    )


def heading_groups(docs: DataFrame) -> DataFrame:
    """Sections of documents without blocks: a line that starts with # opens one."""
    line = F.posexplode(T.lines(F.col("text"))).alias("i", "line")
    rows = docs.select("doc_id", "version_id", line)
    order = Window.partitionBy("doc_id", "version_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = T.strip(F.col("line")).startswith("#")
    rows = rows.withColumn("section_no", F.sum(opens.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("i", "line")))
    rows = rows.groupBy("doc_id", "version_id", "section_no").agg(parts.alias("parts"))
    first = T.strip(F.col("parts")[0]["line"])
    section = F.when(first.startswith("#"), T.strip(F.regexp_replace(first, "^#+", "")))
    none = F.lit(None).cast("int")
    return rows.select("doc_id", "version_id", "section_no", section.alias("section"), T.strip(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("text"), none.alias("page_start"), none.alias("page_end"), none.alias("first_char"), F.lit(None).cast("long").alias("section_block_count"))


def section_aware(docs: DataFrame, config: Chunking = Chunking(), blocks: DataFrame | None = None) -> DataFrame:
    """Character windows within sections; chunks are numbered through the document."""
    if blocks is None:
        groups = heading_groups(docs)
    else:
        bare = docs.join(blocks.select("doc_id", "version_id").distinct(), ["doc_id", "version_id"], "left_anti")
        groups = section_groups(blocks).unionByName(heading_groups(bare))
    rows = groups.select("*", F.posexplode(char_windows(F.col("text"), config)).alias("n", "w"))
    rows = rows.select("doc_id", "version_id", "section_no", "n", "section", "page_start", "page_end", "section_block_count", F.col("w.text").alias("text"), (F.col("first_char") + F.col("w.start")).alias("char_start"), (F.col("first_char") + F.col("w.end")).alias("char_end"))
    more = [c for c in _carried(docs) if c not in ("doc_id", "version_id")]
    if more:
        rows = rows.join(docs.select("doc_id", "version_id", *more), ["doc_id", "version_id"])
    index = F.row_number().over(Window.partitionBy("doc_id", "version_id").orderBy("section_no", "n")) - 1
    return _finish(rows, config, "section_aware", index).drop("section_no", "n")


CHUNKERS: Registry = Registry("chunker", character=character, fixed_token=fixed_token, section_aware=section_aware)


def report(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Counts and token statistics over all chunks (doc_id null, whole true) and of every document;
    documents without chunks are kept."""
    have = set(chunks.columns)
    lacks = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")) if c in have else F.count("*")
    stats = chunks.groupingSets([[], ["doc_id"]], "doc_id").agg(
        F.grouping("doc_id").cast("boolean").alias("whole"),
        F.count("*").alias("chunk_count"),
        F.round(F.avg("token_count"), 2).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.count_if(T.is_blank(F.col("text"))).alias("empty_count"),
        lacks("doc_id").alias("missing_doc_id"),
        lacks("source_path").alias("missing_source_path"),
        lacks("page_start").alias("missing_page"),
        lacks("section").alias("missing_section"),
    )
    if docs is None:
        return stats
    rest = docs.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    zero = [F.lit(0).cast(t).alias(c) if c not in ("avg_tokens", "min_tokens", "max_tokens") else F.lit(None).cast(t).alias(c) for c, t in stats.dtypes[2:]]
    return stats.unionByName(rest.select("doc_id", F.lit(False).alias("whole"), *zero))


@dataclass(frozen=True)
class QualityGates:
    """Thresholds of the chunk quality check."""

    min_avg_tokens: float = 1
    max_avg_tokens: float = 1200
    max_missing_page: float = 0.05
    max_missing_section: float = 0.5
    avg_severity: str = "warning"
    section_severity: str = "warning"


def quality_issues(chunks: DataFrame, document_count: Column | int, gates: QualityGates = QualityGates()) -> DataFrame:
    """(code, severity, value) of the gates that a chunk set fails; no row means that it passes, as does
    one without an error among them. All gates come from one aggregate."""
    have = set(chunks.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    none = lambda c: col(c).isNull() | (T.strip(col(c)) == "")
    suffix = F.lower(F.col("metadata")["suffix"]) if "metadata" in have else F.lit(None).cast("string")
    paged = F.coalesce(suffix == ".pdf", F.lit(False)) | F.coalesce(F.lower(col("source_path")).endswith(".pdf"), F.lit(False))
    a = chunks.agg(
        F.count("*").alias("n"),
        F.count_if(none("doc_id")).alias("no_doc"),
        F.count_if(none("source_path")).alias("no_path"),
        F.count_if(none("text")).alias("blank"),
        F.avg("token_count").alias("avg"),
        F.count_if(paged).alias("paged"),
        F.count_if(paged & col("page_start").isNull()).alias("no_page"),
        F.count_if(none("section")).alias("no_section"),
    )
    n = F.col("n")
    share = lambda x, of: F.col(x) / F.nullif(of, F.lit(0))
    count = F.lit(document_count) if isinstance(document_count, int) else document_count
    found = [
        ("no_chunks_created", "error", (n == 0) & (count > 0), n),
        ("missing_doc_id", "error", F.col("no_doc") > 0, F.col("no_doc")),
        ("missing_source_path", "error", F.col("no_path") > 0, F.col("no_path")),
        ("empty_chunk_found", "error", F.col("blank") > 0, F.col("blank")),
        ("avg_token_count_too_low", gates.avg_severity, (n > 0) & (F.col("avg") < gates.min_avg_tokens), F.col("avg")),
        ("avg_token_count_too_high", gates.avg_severity, (n > 0) & (F.col("avg") > gates.max_avg_tokens), F.col("avg")),
        ("missing_pdf_page_ratio_too_high", "error", share("no_page", F.col("paged")) > gates.max_missing_page, share("no_page", F.col("paged"))),
        ("missing_section_ratio_too_high", gates.section_severity, share("no_section", n) > gates.max_missing_section, share("no_section", n)),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.coalesce(w, F.lit(False)).alias("bad"), v.cast("double").alias("value")) for c, s, w, v in found])
    return a.select(F.explode(F.filter(rows, lambda x: x["bad"])).alias("x")).select("x.code", "x.severity", F.round("x.value", 6).alias("value"))
