"""Cleaning of pages extracted from paginated documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class PageCleaning:
    """What counts as a repeated header or footer line."""

    edge_lines: int = 2
    min_ratio: float = 0.6
    min_length: int = 3
    max_length: int = 120

    def __post_init__(self):
        if self.edge_lines <= 0 or not 0 < self.min_ratio <= 1 or self.min_length <= 0 or self.max_length < self.min_length:
            raise ValueError(f"no sound page cleaning: {self}")


def edge_lines(pages: DataFrame, config: PageCleaning = PageCleaning()) -> DataFrame:
    """(doc_id, line) of the lines that repeat at the top or bottom of the pages (doc_id, page, text)."""
    stripped = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x != "")
    n = config.edge_lines
    tail = F.when(F.size("all") > n, F.slice("all", -n, n)).otherwise(F.col("all"))
    rows = pages.select("doc_id", stripped.alias("all"))
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    # outer: else Spark asks first whether there are lines, and computes them again and again for that
    lines = rows.select("doc_id", F.explode_outer(F.array_distinct(F.concat(F.slice("all", 1, n), tail))).alias("line")).where(F.length("line").between(config.min_length, config.max_length))
    lines = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.ceil(F.col("pages") * config.min_ratio))
    return lines.join(counted, "doc_id").where((F.col("pages") >= 3) & (F.col("n") >= least)).select("doc_id", "line")


def without_edge_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages without the found lines; `removed` counts them per page."""
    sets = found.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    kept = F.filter("all", lambda x: ~F.array_contains(F.col("gone"), T.strip(x)))
    rows = pages.join(sets, "doc_id", "left").withColumn("all", F.when(F.col("gone").isNotNull(), T.lines(F.col("text")))).withColumn("kept", kept)
    return rows.select("doc_id", "page", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("all") - F.size("kept")).alias("removed"))


def join_lines(c: Column) -> Column:
    """Paragraphs from the broken lines of a page: words cut by a hyphen are mended, lines go on until a
    sentence ends, a heading starts or a blank line stands between. What parts two lines follows from them alone."""

    def ends(x):
        return F.substring(x, -1, 1).isin(*".?!\u3002\uff1f\uff01:\uff1a")

    def heading(x):
        return x.rlike(r"(?U)^\d+(\.\d+)*\s+\S+") | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) <= 120))

    def hyphen(x, y):
        return x.endswith("-") & y.rlike(r"^\p{Ll}")

    def between(x, y):
        return F.when(hyphen(x, y), "").when((x != "") & ~ends(x) & ~heading(y), " ").otherwise("\n\n")

    def piece(rows, x, i):
        before, after = (F.coalesce(F.get(rows, i + step), F.lit("")) for step in (-1, 1))
        bare = F.when(hyphen(x, after), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)
        return F.when(x == "", "").otherwise(F.concat(between(before, x), bare))

    pieces = T.once(F.transform(T.lines(c), T.strip), lambda rows: F.transform(rows, lambda x, i: piece(rows, x, i)))
    return F.substring(F.array_join(pieces, ""), 3, 2147483647)


def clean_pages(pages: DataFrame, config: PageCleaning = PageCleaning()) -> DataFrame:
    """(doc_id, text, page_count, removed_edge_lines, issues) of paginated documents."""
    found = edge_lines(pages, config)
    rows = without_edge_lines(pages, found).withColumn("joined", T.strip(join_lines(F.col("text"))))
    issue = F.struct(F.lit("pdf_repeated_edge_lines_removed").alias("code"), F.lit("info").alias("severity"), F.col("page"), F.col("removed"))
    per = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "joined"))).alias("parts"),
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(F.when(F.col("removed") > 0, issue))).alias("issues"),
    )
    text = T.clean(F.array_join(F.filter(F.transform("parts", lambda p: p["joined"]), lambda x: x != ""), "\n\n"))
    lines = found.groupBy("doc_id").agg(F.count("*").alias("removed_edge_lines"))
    return per.join(lines, "doc_id", "left").select("doc_id", text.alias("text"), "page_count", F.coalesce("removed_edge_lines", F.lit(0)).alias("removed_edge_lines"), "issues")
