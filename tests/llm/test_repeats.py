"""Substring and suffix deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresift.llm import _repeats
from loresift.llm._repeats import multikey_quicksort
from loresift.llm.substring import substring_dedup
from loresift.llm.suffix import suffix_dedup


def brute(units, length):
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), dtype=bool)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def brute_words(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    return sorted((i, len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(rows, words, brute(words, length)))


def brute_bytes(rows, length):
    out = []
    texts = [list((t or "").encode()) for _, t in rows]
    for (i, _), t, g in zip(rows, texts, brute(texts, length)):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(t), int(g.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(t, g) if not y)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, vocab=30):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "c", "dé", "efg", "hi", "日本", "k"]) + str(r.randrange(vocab))
    passages = [" ".join(word() for _ in range(r.randrange(20, 90))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 5)):
            if r.random() < 0.5:
                p = r.choice(passages).split()
                a = r.randrange(len(p) // 2)
                parts.append(" ".join(p[a : a + r.randrange(5, len(p))]))
            else:
                parts.append(" ".join(word() for _ in range(r.randrange(1, 60))))
        t = "\n".join(parts)
        if r.random() < 0.15 and rows:
            t = r.choice(rows)[1] or ""
        if r.random() < 0.2 and t:
            w = t.split(" ")
            w[r.randrange(len(w))] = word()
            t = " ".join(w)
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "aa " * 200), (n + 4, "x"), (3, rows[3][1]), (4, "other text of id four")]


@pytest.mark.parametrize("seed,length", [(1, 35), (2, 12), (3, 8)])
def test_words_equal_brute_force(spark, seed, length):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in substring_dedup(df, min_words=length, seed_words=4).digests().collect())
    assert got == brute_words(rows, length)


@pytest.mark.parametrize("seed,length", [(4, 200), (5, 64), (6, 17)])
def test_bytes_equal_brute_force(spark, seed, length):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup(df, min_bytes=length, seed_bytes=12, block=4 if length < 64 else 8).digests().collect())
    assert got == brute_bytes(rows, length)


def test_texts_keep_other_columns_and_clean_rows(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one " + passage, "k1"), (2, passage + " two", "k2"), (3, passage, "k3"), (4, "clean  text", "k4"), (None, None, "k5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted((r["doc_id"] or 0, r["text"], r["mark"]) for r in substring_dedup(df).texts().collect())
    assert got == [(0, None, "k5"), (1, "one", "k1"), (2, "two", "k2"), (4, "clean  text", "k4")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).digests().collect() == []
    assert suffix_dedup(df).digests().collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000, 200_000])
def test_multikey_quicksort_orders_like_lexsort(n):
    r = np.random.default_rng(n)
    cols = [r.integers(-3, 3, n), r.integers(-2, 40, n), r.integers(-(2**62), 2**62, n)]
    order = multikey_quicksort(cols)
    expected = np.lexsort(cols[::-1])
    assert all((c[order] == c[expected]).all() for c in cols)


@pytest.mark.parametrize("bits", [6, 8])
def test_anchors_of_texts_longer_than_the_place_bits(monkeypatch, bits):
    monkeypatch.setattr(_repeats, "_LOW", np.uint64((1 << bits) - 1))
    r = random.Random(bits)
    u = _repeats.Units([bytes(r.choice(b"abcdefgh") for _ in range(3000))], "byte")
    _, first, n, place, _, _ = _repeats.zones_of(u, 40, 12)
    i = np.arange(3000 - 12 + 1)
    anchors = u.hash.of(i, i + 12) & ~_repeats._LOW
    want = [s + int(np.argmin(anchors[s : s + 29])) for s in range(3000 - 40 + 1)]
    assert np.repeat(place, n).tolist() == want and np.repeat(first, n).tolist() == [f for f, m in zip(first, n) for _ in range(m)]


def test_equal_rows_cost_no_square(spark):
    """Copies under one id share their findings: ten thousand of them go through, each cut whole."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.range(10_000).selectExpr("7L AS doc_id").withColumn("text", F.lit(text)).union(spark.createDataFrame([(8, "own " + text + " end")], "doc_id long, text string"))
    got = substring_dedup(rows).digests().groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, 300, 300, 10_000), (8, 302, 300, 1)]
    got = suffix_dedup(rows).digests().groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, len(text), 10_000), (8, len(text), 1)]


@pytest.mark.parametrize("copies", [10, 300])
def test_a_phrase_that_many_different_places_share(spark, copies):
    """Few places are extended against each other, many are sorted: equal results either way."""
    r = random.Random(copies)
    phrase = [f"p{i}" for i in range(10)]
    near = [[f"a{r.randrange(2)}" for _ in range(6)] for _ in range(4)], [[f"b{r.randrange(2)}" for _ in range(6)] for _ in range(4)]
    rows = [(i, " ".join([f"l{i}"] * 3 + r.choice(near[0]) + phrase + r.choice(near[1]) + [f"r{i}"] * 3)) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup(df, min_words=18, seed_words=4).digests().collect())
    assert got == brute_words(rows, 18)


def test_extension_finds_the_maximal_repeat(spark):
    r = random.Random(2)
    shared = [f"s{i}" for i in range(90)]
    rows = [(i, " ".join([f"x{i}_{j}" for j in range(r.randrange(1, 30))] + shared + [f"y{i}_{j}" for j in range(r.randrange(1, 30))])) for i in range(2)]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).found.collect()
    assert [[(s["start"], s["end"]) for s in f["spans"]] for f in sorted(found)] == [[(rows[f["doc_id"]][1].split().index("s0"), rows[f["doc_id"]][1].split().index("s89") + 1)] for f in sorted(found)]


def test_rows_without_an_id_stay_apart(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text + " more"), (None, "other"), (None, None)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).digests().collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in got) == [(None, 0, 0), (None, 1, 0), (None, 50, 50), (None, 51, 50)]


def test_passage_behind_a_very_long_opening(spark):
    """A repeat that starts beyond 2**24 units of a text is found like any other."""
    r = np.random.default_rng(1)
    opening = r.integers(97, 123, 17 << 20).astype(np.uint8).tobytes().decode()
    passage = r.integers(97, 123, 400).astype(np.uint8).tobytes().decode()
    rows = [(1, opening + passage + "#" * 9), (2, "!" * 9 + passage + "?")]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).digests().collect()
    assert sorted((x["doc_id"], x["n_removed"], x["n_spans"]) for x in got) == [(1, 400, 1), (2, 400, 1)]
