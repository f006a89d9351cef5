"""Documents too long for a row: chunks of texts that come as lines, (doc_id, line_no, text).

What a line needs to know of the lines before it (its place in the text, its section, how many chunks came first)
is a running sum or the last value of something. `scanned` computes these without bringing a document together:
rows are range-partitioned, so that a long document lies in many partitions; each partition sums up its part, only these
sums are carried from partition to partition, and the rest happens inside. Only what is summed is moved for that; texts
meet the sums by line, and move once more as the windows they touch, each put together from as many lines as a window is
long at most.

Results equal those of `chunk.character` and `chunk.section_aware` (without blocks) over the whole texts, whose lines are
joined by line feeds. Rows without a doc_id or line_no are passed over, a null text is an empty line; of a document
line numbers must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.session import stored
from .chunk import Chunking


def scanned(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """`rows`, which should hold no texts, with, for each key in order, the sums of what came before a row, and the
    last values that are not null up to it."""
    sums, lasts = sums or {}, lasts or {}
    values = {f"_{n}": c for n, c in (sums | lasts).items()}
    ranged = rows.withColumns(values).repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    last = lambda n: F.max(F.when(F.col(f"_{n}").isNotNull(), F.struct(*order, F.col(f"_{n}").alias("v"))))
    totals = ranged.groupBy("_part", *key).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums], *[last(n)["v"].alias(f"_{n}") for n in lasts])
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = totals.select("_part", *key, *[F.sum(f"_{n}").over(before).alias(f"_before_{n}") for n in sums], *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in lasts])
    inside = Window.partitionBy("_part", *key).orderBy(*order)
    zero = F.lit(0).cast("long")
    own = {n: F.coalesce(F.col(f"_before_{n}"), zero) + F.coalesce(F.sum(f"_{n}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero) for n in sums}
    own |= {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col(f"_before_{n}")) for n in lasts}
    out = ranged.join(carried, ["_part", *key]).withColumns(own)
    return out.drop("_part", *[f"_{n}" for n in own], *[f"_before_{n}" for n in own])


def _usable(lines: DataFrame) -> DataFrame:
    return lines.where("doc_id IS NOT NULL AND line_no IS NOT NULL").select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("text"))


def placed(lines: DataFrame) -> DataFrame:
    """Lines with char_start, their place in the whole text, and section, the last heading up to them."""
    bare, own = T.strip(F.col("text")), _usable(lines)
    heading = F.when(bare.startswith("#"), T.strip(F.regexp_replace(bare, "^#+", "")))
    facts = own.select("doc_id", "line_no", (F.length("text").cast("long") + 1).alias("size"), heading.alias("heading"))
    places = scanned(facts, ["doc_id"], ["line_no"], {"char_start": F.col("size")}, {"section": F.col("heading")})
    return own.join(places.drop("size", "heading"), ["doc_id", "line_no"])


def _windows(pieces: DataFrame, key: list[str], config: Chunking) -> DataFrame:
    """(key, window, chunk_index, text, start, end) from pieces (key, at, text): stripped windows at every step, those
    that are not blank numbered within the first column of the key. Which are blank is told from the pieces alone."""
    pieces = stored(pieces.where(F.length("text") > 0), "pieces")
    size, step = config.size, config.size - config.overlap
    end = F.col("at") + F.length("text")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - size) / step) + 1)
    touched = pieces.withColumn("window", F.explode(F.sequence(first, F.floor((end - 1) / step))))
    skip = F.greatest(F.col("window") * step - F.col("at"), F.lit(0))
    upto = F.least(F.col("window") * step + size, end) - F.col("at")
    part = F.col("text").substr((skip + 1).cast("int"), (upto - skip).cast("int"))
    some = touched.where(T.strip(part) != "").select(*key, "window").distinct()
    numbers = scanned(some, key[:1], [*key[1:], "window"], {"chunk_index": F.lit(1).cast("long")})
    parts = touched.groupBy(*key, "window").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))).alias("parts"))
    raw = parts.select(*key, "window", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("raw")).join(numbers, [*key, "window"])
    left = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    rows = raw.select(*key, "window", "chunk_index", T.strip(F.col("raw")).alias("text"), (F.col("window") * step + left).alias("start"))
    return rows.withColumn("end", F.col("start") + F.length("text"))


def character(lines: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, text): character windows over whole texts."""
    pieces = placed(lines).select("doc_id", F.col("char_start").alias("at"), F.concat("text", F.lit("\n")).alias("text"))
    return _windows(pieces, ["doc_id"], config).select("doc_id", "chunk_index", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "text")


def section_aware(lines: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(doc_id, chunk_index, section, text): character windows within sections, which lines that start with # open."""
    bare, own = T.strip(F.col("text")), _usable(lines)
    opens, some = bare.startswith("#"), bare != ""
    one = lambda c: c.cast("long")
    left = F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))
    heading = F.when(opens, T.strip(F.regexp_replace(bare, "^#+", "")))
    facts = own.select("doc_id", "line_no", (F.length("text").cast("long") + 1).alias("size"), left.alias("left"), opens.alias("opens"), some.alias("some"), heading.alias("heading"))
    facts = scanned(facts, ["doc_id"], ["line_no"], {"char_start": F.col("size"), "opened": one(F.col("opens")), "seen": one(F.col("some"))})
    # a section starts with its first character that is no white space
    first = F.col("opens") | ((F.col("opened") == 0) & (F.col("seen") == 0) & F.col("some"))
    facts = facts.withColumns({"section_no": F.col("opened") + one(F.col("opens")), "first": first})
    facts = scanned(facts, ["doc_id"], ["line_no"], lasts={"begin": F.when(F.col("first"), F.col("char_start") + F.col("left")), "section": F.col("heading")})
    facts = facts.where("begin IS NOT NULL").select("doc_id", "line_no", "section_no", "section", "first", F.greatest(F.col("char_start") - F.col("begin"), F.lit(0).cast("long")).alias("at"))
    text = F.concat(F.when(F.col("first"), F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text")), F.lit("\n"))
    named = facts.where("first").select("doc_id", "section_no", "section")
    pieces = own.join(facts, ["doc_id", "line_no"]).select("doc_id", "section_no", "at", text.alias("text"))
    rows = _windows(pieces, ["doc_id", "section_no"], config).join(named, ["doc_id", "section_no"])
    return rows.select("doc_id", "chunk_index", "section", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of texts that fit a row."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
