"""Cleaning, tokens, identity."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.functions import text as T
from loresift.operators import clean as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


def test_clean_literals(spark):
    assert one(spark, "#    Grüße 水   \n\n\n\nerste Zeile\t \n\n\n###   Ende  \nletzte。 ", T.clean) == "# Grüße 水\n\nerste Zeile\n\n### Ende\nletzte。"
    assert one(spark, "x\r\n\tindented \r  two\r", T.clean) == "x\n\tindented\n  two"
    assert one(spark, "", T.clean) == ""


def test_token_literals(spark):
    mixed = "Blue_7 fish: 水草, ok?"
    assert one(spark, mixed, T.budget_tokens) == len(["Blue_7", "fish", ":", "水", "草", ",", "ok", "?"])
    assert one(spark, mixed, T.search_tokens) == ["blue_7", "fish", "水", "草", "ok"]
    spans = "e.g. the D.C. rate was 7.5/8 at 10:30, don't ask."
    want = ["e.g.", "the", "D.C.", "rate", "was", "7.5/8", "at", "10:30", ",", "don't", "ask", "."]
    assert one(spark, spans, T.chunk_tokens) == want and one(spark, spans, lambda c: T.token_count(c, "simple_regex")) == len(want)
    assert one(spark, "🐟b", T.token_count) == 2


def test_identity(spark):
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()[:12]
    assert one(spark, "/数据/a.md", T.document_id) == "doc_" + sha("/数据/a.md")
    assert one(spark, "doc_1", lambda c: T.version_id(c, F.lit("h"))) == "v_" + sha("doc_1:h")
    assert one(spark, "文本", lambda c: T.part_id("chunk", F.lit("v_1"), F.lit(3), c)) == "chunk_" + sha("v_1:3:文本")


def test_unicode_space(spark):
    assert one(spark, "  　a b  ", T.strip) == "a b"
    assert one(spark, " a 　 b\n", T.squeeze) == "a b"
    assert one(spark, "a\x0bb c\r\nd\n", T.lines) == ["a", "b", "c", "d"]
    assert one(spark, "\n\n", T.lines) == ["", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1_ .中-'!\n\té/:", max_size=40), min_size=1, max_size=20))
def test_tokens_equal_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.search_tokens(F.col("t")).alias("s"), T.budget_tokens(F.col("t")).alias("b"), T.lines(F.col("t")).alias("l"), T.paragraphs(F.col("t")).alias("p")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["s"] == re.findall(r"[a-z0-9_]+|[一-鿿]", t.lower())
        assert r["b"] == len(re.findall(r"[a-zA-Z0-9_]+|[一-鿿]|[^\s]", t))
        assert r["l"] == t.splitlines()
        assert r["p"] == [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]


def test_page_lines(spark):
    pages = spark.createDataFrame([("d", i, f"Yearly Digest\nbody {i} text.\nunlike {'xyz'[i - 1] * 9}") for i in (1, 2, 3)] + [("two", i, "Same\nSame") for i in (1, 2)], "doc_id string, page int, text string")
    assert [tuple(r) for r in C.edge_lines(pages, C.PageCleaning(1, 0.6)).collect()] == [("d", "Yearly Digest")]
    other = pages.withColumn("text", F.when(F.col("page") == 3, F.lit("Other\nbody")).otherwise(F.col("text")))
    assert C.edge_lines(other, C.PageCleaning(1, 1.0)).collect() == []
    out = {r["doc_id"]: r for r in C.clean_pages(pages, C.PageCleaning(1, 0.6)).collect()}
    assert "Yearly" not in out["d"]["text"] and out["d"]["page_count"] == 3 and out["d"]["removed_edge_lines"] == 1
    assert [i["page"] for i in out["d"]["issues"]] == [1, 2, 3] and out["two"]["removed_edge_lines"] == 0


def test_broken_lines(spark):
    assert one(spark, "retrie-\nval is good\nbut long.\n1 Intro\nnext\n\nABC DEF\nends here:\nnew", C.join_lines) == "retrieval is good but long.\n\n1 Intro next\n\nABC DEF ends here:\n\nnew"
    assert one(spark, "问题？\n答案！\n尾", C.join_lines) == "问题？\n\n答案！\n\n尾"


def test_line_joining_equals_the_fold(spark):
    """Lines are joined in one step; a fold that carries the paragraph so far says the same."""
    words = ["", "-", "re-", "val", "Val.", "A B", "1.2 Intro", "ends:", "x-", "Éa", "é", "12", " pad ", "a ", "?"]
    texts = ["\n".join(words[(i * k + j) % len(words)] for i in range(30)) for k in (1, 2, 4, 7) for j in range(4)] + ["", "\n", "-\na", "a -\nb"]

    def fold(text):
        done, now = [], ""
        for x in (x.strip() for x in text.split("\n")):
            hyphen = now.endswith("-") and x[:1].islower()
            heading = re.match(r"\d+(\.\d+)*\s+\S+", x) or (x.upper() == x and x.lower() != x)
            if x and hyphen:
                now = now[:-1] + x
            elif x and now and now[-1] not in ".?!:" and not heading:
                now += " " + x
            else:
                done, now = done + [now], x
        return "\n\n".join(p for p in [*done, now] if p)

    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select("t", C.join_lines(F.col("t")).alias("y")).collect()
    assert [r["y"] for r in rows] == [fold(r["t"]) for r in rows]


def test_page_lines_are_cut_once(spark):
    pages = spark.createDataFrame([("d", 1, "a\nb")], "doc_id string, page int, text string")
    plan = C.edge_lines(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    once = spark.range(1).select(T.lines(F.concat(F.lit("a\n"), F.col("id").cast("string"))).alias("x"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
