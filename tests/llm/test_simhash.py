import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loresift.llm import simhash
from loresift.llm.components import components
from loresift.llm.simhash import fingerprint, group_links, keep_one, links, near_duplicates


def slow_fingerprint(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + words]), seed=42).intdigest() for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_set(r, n):
    out = [r.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = r.choice(out)
        for _ in range(r.randrange(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted(set(out))


def brute_links(fps, k=3):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= k]


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_brute_force(spark, seed):
    fps = near_set(random.Random(seed), 600)
    s = lambda x: x - (1 << 64) if x >> 63 else x
    got = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in links(spark.createDataFrame([(s(x),) for x in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert classes(fps, got) == classes(fps, brute_links(fps))


@pytest.mark.parametrize("limit", [2, 8, 64])
def test_large_groups_are_split_exactly(monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP", limit)
    r = random.Random(limit)
    base = r.getrandbits(64)
    mask = simhash.variant_masks(3)[5][2]
    fps = sorted({(base & mask) | (x & ~mask) for x in near_set(r, 400)} | {base ^ (1 << 40) ^ (1 << i) for i in range(33, 64)})
    fps = [x for x in fps if x & mask == base & mask]
    got = group_links(np.array(fps, dtype=np.uint64), mask, 3)
    assert classes(fps, got) == classes(fps, brute_links(fps))


def test_components_of_a_long_chain_and_a_hub(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == classes(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeÉ日") for _ in range(4))
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(r.randrange(0, 200)))))
    for i in range(60, 120):
        w = r.choice(rows[:60])[1].split()
        if w and r.random() < 0.7:
            w[r.randrange(len(w))] = word()
        rows.append((i, "\n".join(w).upper() if r.random() < 0.1 else "  ".join(w)))
    rows += [(200, None), (201, ""), (202, "One"), (203, "one\ttwo"), (3, rows[3][1]), (None, rows[4][1]), (None, "alone here with a null id of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1)).withColumn("_id", F.lit("y"))
    got = near_duplicates(df).collect()
    fps = {t: slow_fingerprint(t) for _, t in rows}
    assert all(fingerprint((t or "").encode()) == f for t, f in fps.items())
    root = classes(set(fps.values()), brute_links(sorted(set(fps.values()))))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], 1 << 60))
    want = sorted((-1 if i is None else i, fps[t], least.get(root[fps[t]], -1)) for i, t in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["fp"] & (2**64 - 1), -1 if x["component_id"] is None else x["component_id"]) for x in got) == want
    one = keep_one(df)
    assert one.columns == df.columns
    assert sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in one.collect()) == sorted(c for c, _ in {(c, root[f]) for _, f, c in want})
    assert near_duplicates(df.limit(0)).collect() == []
