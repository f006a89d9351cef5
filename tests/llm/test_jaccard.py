import random

import pytest

from loresift.llm import jaccard
from loresift.llm.jaccard import near_copies, prefix, shingle_sets
from tests.llm.test_simhash import classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def slow_set(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    """Smallest id of the component of every id."""
    s = {i: slow_set(t) for i, t in texts.items()}
    ids = sorted(s)
    return classes(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if alike(s[a], s[b])])


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for i in range(n):
        if i < n // 3 or r.random() < 0.1:
            w = [word() for _ in range(r.randrange(0, 150))] + line.split() * r.randrange(0, 2)
        else:  # edits in a chain around 0.8
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return {i: t for i, t in enumerate(texts)} | {n: None, n + 1: " \n", n + 2: "One two", n + 3: "one\ttwo"}


def test_stage_keeps_one_of_texts_alike_by_four_fifths(spark):
    """Below op5's bit bound these pairs are no near-duplicates, by Jaccard they are."""
    texts = corpus(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(brute(texts).values())


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_tables_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()} == want


def test_large_groups_and_frequent_shingles(spark, monkeypatch):
    """A hub of near copies around one text, in groups beyond GROUP, and a line that most texts hold."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: "a very common line of some ten words that all hold " + " ".join(f"y{r.randrange(10**6)}" for _ in range(i % 20)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    assert {x["doc_id"]: x["component_id"] for x in near_copies(df).collect()} == brute(texts)


def test_prefixes_of_linked_sets_meet():
    r = random.Random(2)
    texts = list(corpus(5).values())
    sets = shingle_sets([(t or "").encode() for t in texts])
    last = sorted(r.sample(sorted({int(x) for s in sets for x in s}), 200))
    import numpy as np

    first = [set(prefix(s, np.array(last, dtype=np.uint64), 0.8).tolist()) for s in sets]
    slow = [slow_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in slow]
    assert all(first[i] & first[j] for i in range(len(sets)) for j in range(i) if slow[i] and alike(slow[i], slow[j]))


def test_rows_with_repeated_and_null_ids(spark):
    t = "some words of a text that is long enough to hold shingles"
    df = spark.createDataFrame([(3, t), (3, t), (3, "other words"), (None, t), (None, "alone"), (1, t.upper())], "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == [(-1, "alone"), (1, t.upper()), (3, "other words")]
    assert near_copies(df.limit(0)).collect() == []


def test_fingerprints_link_before_the_exact_search(spark, monkeypatch):
    """Near copies are found by their SimHash variants, with no pair of the search by prefixes; what the bits bring
    together and the sets tell apart stays apart."""
    r = random.Random(4)
    texts = {}
    for i in range(0, 60, 3):
        w = [f"w{r.randrange(10**6)}" for _ in range(400)]
        texts |= {i: " ".join(w), i + 1: " ".join([*w[:-1], "end"]), i + 2: " ".join(f"v{r.randrange(10**6)}" for _ in range(40))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked = []
    monkeypatch.setattr(jaccard, "_first_pairs", lambda rows, least: asked.append(rows) or spark.createDataFrame([], "a long, b long, token long"))
    got = {x["doc_id"]: x["component_id"] for x in near_copies(df).collect()}
    want = brute(texts)
    assert asked and all(got[i] in (i, want[i]) for i in texts)
    assert sum(got[i + 1] == i for i in range(0, 60, 3)) >= 15  # a word at the end seldom turns over three bits
    monkeypatch.undo()
    monkeypatch.setattr(jaccard, "majority", lambda h: 0)
    assert {x["doc_id"]: x["component_id"] for x in near_copies(df).collect()} == brute(texts)
