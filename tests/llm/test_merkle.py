import itertools
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from loresift.llm.merkle import descent, edits, fingerprints, likeness, sections, tree


def test_edited_text_and_next_over_gaps(spark):
    r = random.Random(3)
    ids = sorted({0, 1, 2, 255, 256, 257, 511, 70_000, 70_001, 5_000_000, 2**33, 2**45 + 7, -5} | {r.randrange(4000) for _ in range(60)})
    rows = [(i, None if i == 2 else "".join(r.choice("abé 日\n😀") for _ in range(r.randrange(0, 700)))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("next", F.lit(1)).withColumn("leaves", F.lit("x"))
    got = {x["doc_id"]: x for x in fingerprints(df).collect()}
    texts = dict(rows)
    for at, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        k = len(t) // 4
        assert got[i]["edited_text"] == t[: len(t) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(t)
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == got[i]["edited_text"])
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        if len(t) > 40 and i != 2:
            assert got[i]["near_edited"] > got[i]["near_next"]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(5, "one line only")][:n], "doc_id long, text string")
    assert [(x["edited_text"], x["near_next"]) for x in fingerprints(df).collect()] == [("one line oone", 1.0)][:n]


def test_repeated_rows_and_equal_texts(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same"), (None, ""), (None, None)], "doc_id long, text string")
    got = fingerprints(df).collect()
    assert len(got) == 5 and len({x["fingerprint"] for x in got}) == 2
    assert len({x["fingerprint"] for x in tree(df).collect()}) == 2


def test_branches_locate_edits(spark):
    a = "t\n\nfirst line\nsecond line\n\nlast one\nend"
    b = "t\n\nfirst line\nsecond lime\n\nlast one\nend"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(edits(sections(F.col("a")), sections(F.col("b"))).alias("e"))
    assert [tuple(x) for x in df.head()["e"]] == [(1, 1)]


def plain_tree(text):
    """The tree's leaves, paragraph by paragraph and section by section, cut by plain rules."""
    out = []
    for s in re.findall(r"(?s).+?(?:\n[ \t]*\n[ \t\n]*|\Z)", text):
        out.append([regex.findall(r"[^\n]{0,126}?(?:[dgy] |[.!?。！？])|[^\n]{1,128}|\n", line) for line in s.splitlines(keepends=True)])
    return out


def test_all_columns_against_plain_trees(spark):
    """Texts as trees of strings instead of hashes: fingerprints are equal where trees are, and likeness,
    start of the edit and leaf counts are those of the strings."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdeginrty,") for _ in range(r.randrange(1, 9)))
    texts = ["".join(word() + r.choice([" ", " ", " ", "\n", "\n\n", "\n \t\n\n", ". "]) for _ in range(r.randrange(0, 400))) for _ in range(40)]
    texts += [texts[3], texts[5] + "x", "\n\n", "\n", "x" * 1000, "", "x" * 1000, "the same. " * 300]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flat = lambda t: [p for s in plain_tree(t) for line in s for p in line]

    def apart(a, b):
        """Lists without their common start and end, and the characters of these."""
        n = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))
        same, a, b = a[:n], a[n:], b[n:]
        n = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(reversed(a), reversed(b)))))
        same += a[len(a) - n :]
        return sum(len("".join(flat_branch(x))) for x in same), a[: len(a) - n], b[: len(b) - n]

    def flat_branch(x):
        return [x] if isinstance(x, str) else [p for y in x for p in flat_branch(y)]

    def near(a, b):
        most = max(len(a), len(b))
        a, b, alike = plain_tree(a), plain_tree(b), 0
        for level in range(3):
            same, a, b = apart(a, b)
            alike += same
            if level < 2:
                a, b = [y for x in a for y in x], [y for x in b for y in x]
        return (alike + sum(map(len, set(a) & set(b)))) / most if most else 1.0

    for i, t in rows:
        nxt, e = texts[(i + 1) % len(texts)], got[i]["edited_text"]
        assert "".join(flat(t)) == t and got[i]["near_edited"] == pytest.approx(near(t, e)) and got[i]["near_next"] == pytest.approx(near(t, nxt))
        assert got[i]["edited_from"] == sum(len(x) for x, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(flat(t), flat(e))))
        digits = lambda x: 33 + 8 * sum(map(len, plain_tree(x))) + max(len(plain_tree(x)) - 1, 0)
        assert len(got[i]["fingerprint"]) == digits(t) and len(got[i]["edited_fingerprint"]) == digits(e)
        assert (got[i]["near_next"] == 1) == (t == nxt) and (got[i]["near_edited"] == 1) == (t == e)
        for j, u in rows:
            assert (got[i]["fingerprint"][:32] == got[j]["fingerprint"][:32]) == (t == u)


def test_likeness_is_the_share_of_the_whole_text(spark):
    r = random.Random(9)
    new = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxy      .") for _ in range(n))
    a = new(6000)
    rows = [(a, new(1000) + a[1000:]), (a, a[:1000] + new(5000)), (a, a[:4500] + new(1500)), (a, "!" + a), (a, a[:3000] + "q" + a[3000:])]
    of = lambda c: sections(F.col(c))
    got = [x["l"] for x in spark.createDataFrame(rows, "a string, b string").select(likeness(descent(of("a"), of("b"))).alias("l")).collect()]
    assert got[0] == pytest.approx(5 / 6, abs=0.04) and got[1] == pytest.approx(1 / 6, abs=0.04) and got[2] == pytest.approx(0.75, abs=0.04)
    assert got[3] > 0.97 and got[4] > 0.97


def test_equal_branches_are_not_entered(spark):
    """Leaves changed by hand under nodes that stay equal are not seen; those under nodes that differ are."""
    text = "one line. of two\nanother line. of it\n\nthe end. of it all\nand more"
    df = spark.createDataFrame([(text, text.replace("more", "less"))], "a string, b string").select(sections(F.col("a")).alias("a"), sections(F.col("b")).alias("b"))
    empty = lambda p, on: p.withField("leaves", F.when(on, F.array(F.lit(5))).otherwise(p["leaves"]))
    forged = lambda t, at: F.transform(t, lambda s, i: s.withField("paragraphs", F.transform(s["paragraphs"], lambda p, j: empty(p, (i == at[0]) & (j == at[1])))))
    plain = df.select(likeness(descent(F.col("a"), F.col("b")))).head()[0]
    under = lambda at: df.select(likeness(descent(F.col("a"), forged(F.col("b"), at)))).head()[0]
    assert plain == 1 - len("and more") / len(text) + len("and ") / len(text)
    assert [under(at) == plain for at in [(0, 0), (0, 1), (1, 0), (1, 1)]] == [True, True, True, False]


def test_fingerprints_of_long_texts_are_short(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 2000")
    got = tree(docs).join(docs.select("doc_id", "n_chars"), "doc_id").agg(F.sum(F.length("fingerprint")), F.sum("n_chars")).head()
    assert got[0] < 0.05 * got[1]


def test_a_quarter_of_new_text_is_a_quarter_less_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 1000")
    got = [x["near_edited"] for x in fingerprints(docs).collect()]
    assert 0.68 < sum(got) / len(got) < 0.8


def test_no_window_over_all_ids(spark):
    ids = spark.range(1000).selectExpr("xxhash64(id) AS doc_id", "cast(id AS string) AS text")
    out = fingerprints(ids.unionByName(spark.range(500).selectExpr("cast(NULL AS long) AS doc_id", "concat('t', id) AS text")))
    rows = out.collect()
    assert len(rows) == 1500
    text = {}
    for d in sorted(x for x in ids.collect()):
        text[d["doc_id"]] = d["text"]
    order = sorted(text)
    found = {x["doc_id"]: x for x in rows if x["doc_id"] is not None}
    assert all(found[a]["near_next"] == (1.0 if text[a] == text[b] else 0.0) for a, b in zip(order, order[1:]))


def test_deep_runs_of_blank_lines_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "a" + "\n \n" * 50_000 + "b"), (2, "\n" * 100_000), (3, "x" * 200_000)], "doc_id long, text string")
    assert fingerprints(df).count() == 3 and fingerprints(df).agg(F.sum(F.length("fingerprint"))).head()[0] > 0
