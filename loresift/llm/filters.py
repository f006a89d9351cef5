"""Filter interaction audit by inclusion and exclusion.

Five filters A to E are judged on every whole text. For all 32 sets of them the audit aggregates how many
documents of a part fail every filter of the set: sums of products of the flags. Möbius inversion then gives
what any order of filters does, without running one: what survives a set of filters is the alternating sum
over its subsets, what fails one filter only is the alternating sum over its supersets, and the dividends of
the game "removed by a set of filters" are the joint counts with alternating sign, so that a filter's Shapley
value is the sum of its sets' dividends, each divided by the set's size.

Copies of a text in one part are combined before their counts are shuffled, and labels are joined to rows
that are told apart by id, text and part, so that no id, text or part gathers its rows in one task.

Defined results: a null text counts as empty and a null source as the part ''; an empty text has no words, so it
fails A only, and E where a smaller id is empty too; a row without an id fails E never and has no label;
rows that repeat an id and a text don't fail E by each other; a document is good or toxic if any of its
labels says so; labels of unknown documents count nowhere; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "ABCDE"
SETS = range(1 << len(NAMES))
MEASURES = ("n", "good", "toxic")
_ORDERS = 120  # of five filters


def flags(text: Column) -> dict[str, Column]:
    """The filters that a text fails by itself."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * different < 65 * n,
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, same, A, B, C, D, n, n_E, good, good_E, toxic, toxic_E): for every text of a part its flags, how many
    documents have it, and how many of them fail E; the same of good and of toxic ones."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), *[f.cast("long").alias(k) for k, f in flags(F.col("text")).items()])
    own = list(NAMES[:4])
    one = rows.groupBy("id", "part", "same", *own).agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(w) for c, w in (("quality", "good"), ("toxic", "toxic"))])
    # rows without an id are no group of their own in the join: each is dealt by its text to a key that no label has
    key = F.struct(F.col("id"), F.when(F.col("id").isNull(), F.col("same")).alias("own"))
    labelled = F.struct(F.col("labelled").alias("id"), F.lit(None).cast("binary").alias("own"))
    one = one.withColumn("key", key).join(said.withColumn("other", labelled), F.col("key").eqNullSafe(F.col("other")) & F.col("id").isNotNull(), "left")
    counts = {"n": F.col("n"), **{w: F.col("n") * F.coalesce(F.col(w), F.lit(0)) for w in MEASURES[1:]}}
    one = one.select("id", "part", "same", *own, *[c.alias(w) for w, c in counts.items()])
    sums = F.struct("id", *MEASURES)
    # an id may hold a text more than once in a part; its rows are one by now
    texts = one.groupBy("part", "same", *own).agg(*[F.sum(w).alias(w) for w in MEASURES], *[F.sum(F.when(F.col("id").isNull(), F.col(w))).alias(f"{w}_void") for w in MEASURES], F.min(F.when(F.col("id").isNotNull(), sums)).alias("first"))
    least = texts.groupBy("same").agg(F.min("first.id").alias("least"))
    texts = texts.join(least, "same")
    # all fail E but those without an id and those that have the smallest id of the text
    spared = {w: F.coalesce(f"{w}_void", F.lit(0)) + F.when(F.col("first.id") == F.col("least"), F.col(f"first.{w}")).otherwise(0) for w in MEASURES}
    return texts.select("part", "same", *own, *[c for w in MEASURES for c in (F.col(w), (F.col(w) - spared[w]).alias(f"{w}_E"))])


def joint_counts(texts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays by set of filters (bit i: filter i) of how many documents fail all of the set."""

    last = len(NAMES) - 1

    def product(measure: str, members: int) -> str:
        return " * ".join([f"{measure}_{NAMES[last]}" if members >> last & 1 else measure, *(NAMES[i] for i in range(last) if members >> i & 1)])

    sums = texts.groupBy("part").agg(*[F.expr(f"sum({product(m, s)}) AS {m}{s}") for m in MEASURES for s in SETS])
    return sums.select("part", *[F.array(*[f"{m}{s}" for s in SETS]).alias(m) for m in MEASURES])


def _inverted(joint: str, members: str, places: int, weight: str) -> Column:
    """For each of `places` p the sum over all sets s with `members` of the joint count, with the sign of the
    set's size, times `weight`."""
    term = f"if({members}, {joint}[s] * {weight} * (1 - 2 * (bit_count(s) % 2)), 0L)"
    return F.expr(f"transform(sequence(0, {places - 1}), p -> aggregate(sequence(0, {len(SETS) - 1}), 0L, (total, s) -> total + {term}))")


def survivors(joint: str) -> Column:
    """By set of filters, the documents that fail none of it: over its subsets."""
    return _inverted(joint, "s & p = s", len(SETS), "1")


def only(joint: str) -> Column:
    """By filter, the documents that fail it and no other: over its supersets."""
    return _inverted(joint, "shiftright(s, p) % 2 = 1", len(NAMES), "-1")


def shapley(joint: str) -> Column:
    """By filter, what it removes, summed over all orders: a set's dividend goes to its members in equal parts."""
    return _inverted(joint, "shiftright(s, p) % 2 = 1", len(NAMES), f"-({_ORDERS} div bit_count(s))")


def interactions(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row for every part, order of the filters and step: part, filter_order, step, and the counts kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley."""
    joint = joint_counts(judged(docs, labels, **columns))
    parts = joint.select("part", F.col("n").alias("joint"), *[survivors(m).alias(m) for m in MEASURES], only("n").alias("only"), shapley("n").alias("shapley"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(NAMES)])
    rows = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))).alias("step"))
    # the sets before and after a step, as indices into what survives
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    before = F.aggregate(F.split(F.expr("left(filter_order, step - 1)"), ""), F.lit(0), lambda total, c: total + F.when(c != "", bit(c)).otherwise(0))
    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("before", before)
    rows = rows.withColumn("own", bit(F.col("letter"))).withColumn("after", F.col("before") + F.col("own"))
    lost = {m: F.col(m)[F.col("before")] - F.col(m)[F.col("after")] for m in MEASURES}
    index = F.ascii("letter") - ord("A")
    return rows.select(
        "part", "filter_order", "step",
        F.col("n")[F.col("after")].alias("kept"),
        lost["n"].alias("removed"),
        (F.col("joint")[F.col("own")] - lost["n"]).alias("redundant"),
        F.col("only")[index].alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.col("shapley")[index].alias("shapley"),
    )
