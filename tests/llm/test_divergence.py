"""Divergence audit against exact arithmetic on plain counters."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresift.llm.divergence import Tile, counted, divergence, shares, term_counts

ROWS = (
    [(f"alpha beta{i % 7} Straße über alpha", "de", f"s{i % 4}") for i in range(60)]
    + [(f"Alpha gamma x{i % 3}y É", "fr", "s0" if i % 2 else None) for i in range(40)]
    + [("rare words only", "it", "s0"), ("rarer words", "it", "s1"), (None, "de", "s9"), ("", None, "s9"), ("123 !?", "de", "s8"), ("alpha " * 3000, "de", "s1")]
)


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, least=30, top=50):
    docs = [(terms_of(t), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {x[1] for x in docs}:
        df = Counter(t for ts, own, _ in docs if own == lang for t in set(ts))
        keep = sorted((t for t in df if df[t] >= least), key=str.encode)
        count = {s: Counter(t for ts, own, src in docs if own == lang and src == s for t in ts) for s in {x[2] for x in docs if x[1] == lang}}
        whole = sum(count.values(), Counter())

        def p(c):
            n = sum(c[t] for t in keep)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(keep)) for t in keep}

        q = p(whole)
        for s, c in count.items():
            own = p(c)
            pairs = [(sum(abs(own[t] - p(d)[t]) for t in keep), o) for o, d in count.items() if o != s]
            over = [(own[t] - q[t], t) for t in keep if c[t] and own[t] > q[t]]
            for part, found in (("pair", pairs), ("term", over)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[: top if part == "term" else None], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("t")).withColumn("n", F.lit(1)).withColumn("block", F.lit(3)).withColumn("uses", F.lit(0))


@pytest.mark.parametrize("cells", [1 << 18, 7, 1])
def test_against_counters(spark, cells):
    """Also with tiles of a few cells: many blocks, strips, and matrices that are never whole."""
    got = [tuple(r) for r in divergence(frame(spark, ROWS), cells=cells).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS)


def test_other_limits(spark):
    got = {tuple(r) for r in divergence(frame(spark, ROWS), least_docs=1, top=3, cells=50).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(ROWS, 1, 3)


def test_empty(spark):
    assert divergence(frame(spark, ROWS).limit(0)).collect() == []


def test_shares_are_exact():
    r = np.random.default_rng(1)
    total = r.integers(1, 9 * 10**15, 2000)
    count = (total * r.random(2000)).astype(np.int64)
    assert shares(count, total).tolist() == [10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]


def test_long_texts_are_counted_alike(monkeypatch):
    text = ("Ünder the Sea-side 42 naïve " * 500).encode()
    whole = counted(text)
    monkeypatch.setattr("loresift.llm.divergence._LONG", 10)
    assert counted(text) == whole == Counter(t.encode() for t in terms_of(text.decode()))


def test_flushed_counts_add_up(spark, monkeypatch):
    rows = frame(spark, ROWS)
    whole = {tuple(r) for r in term_counts(rows).collect()}
    monkeypatch.setattr("loresift.llm.divergence._HELD", 3)
    assert {tuple(r) for r in term_counts(rows).collect()} == whole


def test_tile_compares_all_pairs_in_strips():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, (6, 40))
    counts[-1] = counts[:-1].sum(axis=0)
    tile = Tile(counts.sum(axis=1), [f"t{i:02d}" for i in range(40)], counts, 40)
    want = np.array([[sum(abs(int(a) - int(b)) for a, b in zip(x, y)) for y in tile.p[:-1]] for x in tile.p[:-1]])
    for cells in (1, 300, 1 << 20):
        got = np.zeros((5, 5), dtype=np.int64)
        tile.pairs(got, cells)
        assert (got == want).all()
    for g, best in tile.largest(4):
        over = [(-int(tile.p[g, i] - tile.p[-1, i]), f"t{i:02d}".encode()) for i in range(40) if counts[g, i] and tile.p[g, i] > tile.p[-1, i]]
        assert best == sorted(over)[:4]
