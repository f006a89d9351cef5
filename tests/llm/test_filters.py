"""Filter audit against plain runs of all orders, on odd rows."""

from itertools import permutations

from pyspark.sql import functions as F

from loresift.llm.filters import flags, interactions

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (2, LONG, "a"), (3, LONG + " #", "a"), (4, "x " * 70, "a"), (5, "X Y " * 40, None), (6, None, "a"), (7, "", "b"), (None, LONG, "a"),
    (None, None, "b"), (8, LONG + " A" * 40, ""), (9, "é ß | " * 30, "c"), (1, "another text", "a"), (10, LONG + "\x0b\x0c\t", "c"), (11, LONG, "a"), (12, "x " * 70, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (5, None, 1)]
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(text, id_, rows):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    out = set()
    out |= {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    same = [i for i, t, _ in rows if (t or "") == text and i is not None]
    return out | ({"E"} if id_ is not None and min(same) < id_ else set())


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s or "" for *_, s in rows}:
        docs = [(i, failing(t or "", i, rows)) for i, t, s in rows if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == {f} for _, x in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("z")).withColumn("n", F.lit(5)).withColumn("least", F.lit(0))
    return interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")))


def test_against_plain_orders(spark):
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in audit(spark, ROWS, LABELS).collect()}
    assert got == plain(ROWS, LABELS)


def test_groups_of_copies(spark):
    rows = [(i, "same text", f"s{i % 3}") for i in range(5000)] + [(9000, LONG, "s0")]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit(spark, rows, LABELS).collect()}
    assert [got[f"s{k}", "EABCD", 1]["removed"] for k in range(3)] == [1666, 1667, 1666]
    assert got["s0", "ABCDE", 5]["redundant"] == 1666 and got["s0", "ABCDE", 5]["kept"] == 1


def test_empty(spark):
    assert audit(spark, ROWS, LABELS).where("false").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert interactions(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_flags_of_an_empty_text(spark):
    assert spark.range(1).select(*[f.alias(k) for k, f in flags(F.lit("")).items()]).first().asDict() == {"A": True, "B": False, "C": False, "D": False}


def test_dividends_are_the_joint_counts_of_five_filters(spark):
    """Efficiency: over all filters the values sum to what all of them remove, 120 times."""
    rows = [r for r in audit(spark, ROWS, LABELS).collect() if r["filter_order"] == "ABCDE"]
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        assert sum(r["shapley"] for r in own) == 120 * sum(r["removed"] for r in own)
