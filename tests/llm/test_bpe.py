"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loresift.llm.bpe import SPECIAL, Codec, decode, encode, vocabulary

LIB = Tokenizer.from_file(vocabulary() + ".json")
SMALL, LARGE = Codec(vocabulary(), 24), Codec(vocabulary())


def expected(text):
    return LIB.encode(text, add_special_tokens=False).ids


def check(text):
    for c in (SMALL, LARGE):
        got = c.encode(text).tolist()
        assert got == expected(text), text
        assert c.decode(np.array(got)) == LIB.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", SPECIAL, f"a{SPECIAL}b", "a" * 5000, " " * 3000, "ab'" * 800, "x's" * 900, "don't'll've" * 300, "<|endof" * 200 + SPECIAL * 3, "é" * 999, "日本語" * 700, "\n" * 400 + "x", "a b" * 300, " " * 50, "12a" * 900, "😀" * 500 + "'s", "aaa " * 2000, "ſ's'S" * 100])
def test_hard_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "'", "'s", " ", "  ", "\n", "1", "é", "日", "!", SPECIAL, "<|", "ing", " ", "\t", "😀", "Qx"]), max_size=200).map("".join))
def test_mixed_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    check(text)


def test_every_plain_character_as_the_library():
    for point in [*range(0x250), *range(0x2000, 0x20C0)]:
        c = chr(point)
        check(f"a{c}b {c}1{c} {c}{c}\n{c}")


def test_long_unsplit_runs():
    r = random.Random(7)
    for alphabet in ("ab", "etaoinshr", "éàè", "a1", "a'", "!?", "01"):
        check("".join(r.choice(alphabet) for _ in range(3000)))


def test_frames(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (3, ""), (None, SPECIAL), (4, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", __import__("pyspark").sql.functions.lit("clash"))
    out = encode(df)
    got = {r["doc_id"]: r["token_ids"] for r in out.collect()}
    assert got == {i: expected(t or "") for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in decode(out).collect()} == {i: t or "" for i, t in rows}
    assert encode(df.limit(0)).collect() == []


def test_long_texts_go_through_the_tree():
    """Texts over a leaf's length are encoded leaf by leaf, whatever they hold; unsplit runs are mended."""
    r = random.Random(3)
    for text in (" ".join("".join(r.choice("etaoin'srh1") for _ in range(r.randrange(1, 12))) for _ in range(4000)), "".join(r.choice("etaoinsrh") for _ in range(30_000)), "é " * 9000 + "x" * 9000):
        c = Codec(vocabulary())
        seen, leaf = [], c.leaf
        c.leaf = lambda t: (seen.append(len(t)), leaf(t))[1]
        assert c.encode(text).tolist() == expected(text)
        assert len(seen) >= len(text) // 2048 and max(seen) < 10_000 and c.pool is not None


def test_joins_wait_until_both_sides_agree():
    c = Codec(vocabulary(), 64)
    text = "".join(random.Random(5).choice("ab") for _ in range(500))
    assert c.join(text, (0, 250, c.leaf(text[:250])), (250, 500, c.leaf(text[250:]))).tolist() == expected(text)
