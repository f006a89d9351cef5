"""Top-k search against brute force in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresift.llm.topk import Shard, bounds, packed, products, top_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, top=20, scale=64):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and ok(v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        found = [(-min(max(sum(a * b for a, b in zip(q, c)), -(1 << 63)), (1 << 63) - 1), j) for j, c in rows if j != i]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(spark, rows, every, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).withColumn("id", F.lit("x")).withColumn("shard", F.lit(9)).withColumn("v", F.lit(0))
    got = top_products(df, F.col("id") % every == 0, **options).select("query_id", "rank", "vec_id", "score").collect()
    return sorted(map(tuple, got))


def clustered(n, width=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, width))
    return [(i, (centres[i % 12] + 0.1 * r.standard_normal(width)).astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("block,shard_rows", [(512, 1 << 17), (16, 100), (1, 64)])
def test_against_brute_force(spark, block, shard_rows):
    rows = clustered(700)
    assert found(spark, rows, 20, block=block, shard_rows=shard_rows) == plain(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 4) + [
        (100, None, 0), (101, [1.0, None, 0.0, 0.0], 0), (120, [nan, 0.0, 0.0, 0.0], 0), (140, [inf, 0.0, 0.0, 0.0], 0), (None, [9.0, 9.0, 9.0, 9.0], 0), (160, [], 0), (180, [0.5], 0),
        (181, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0), (200, [-0.001, -0.5, 0.99, 0.0], 0), (201, [-0.0, 0.0, 0.0, 0.0], 0), (40, [3.0, 1.0, 0.0, 0.0], 1), (300, [2.0, 2.0, 2.0, 2.0], 0), (300, [2.0, 2.0, 2.0, 2.0], 0),
    ]
    assert found(spark, rows, 20, block=8, shard_rows=16) == plain(rows, 20)


def test_ties_and_copies(spark):
    """One vector for all rows: ties everywhere, and no group of its own."""
    rows = [(i, [0.3, -0.7, 0.1], 0) for i in range(3000)]
    got = found(spark, rows, 100, block=64, shard_rows=256)
    assert got == [(q, k + 1, j, 2422) for q in range(0, 3000, 100) for k, j in enumerate([j for j in range(21) if j != q][:20])]


@pytest.mark.parametrize("size", [1e3, 1e8, 1e25, 1e300])
def test_large_components_are_exact(spark, size):
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(5) * size).tolist(), 0) for i in range(50)]
    assert found(spark, rows, 10, "vec_id long, embedding array<double>, label int", block=8) == plain(rows, 10)


def test_few_rows_and_none(spark):
    assert found(spark, clustered(3), 1) == plain(clustered(3), 1)
    assert found(spark, clustered(1), 1) == found(spark, [], 1) == found(spark, clustered(30)[1:], 1000) == []


def test_blocks_are_skipped_only_below_the_kth_score():
    r = np.random.default_rng(4)
    centres = r.integers(-60, 60, (30, 16))
    rows = np.repeat(centres, 40, axis=0) + r.integers(-3, 4, (1200, 16))
    blocks = []
    for a in range(0, 1200, 40):
        kind, data = packed(rows[a : a + 40].astype(float))
        blocks.append((np.arange(a, a + 40), kind, 16, data))
    shard, q = Shard(blocks), rows[::40].astype(float)
    ids = np.arange(0, 1200, 40)
    best, scored = shard.search(q, ids, np.full(30, -(1 << 63)), 20)
    assert scored < 0.5 * 30 * 30  # most blocks are never scored
    for n, (s, v) in zip(ids, best):
        want = sorted((-int(x), j) for j, x in enumerate(rows @ rows[n]) if j != n)[:20]
        assert list(zip((-s).tolist(), v.tolist())) == want


def test_bounds_hold():
    r = np.random.default_rng(5)
    x, q = r.integers(-99, 99, (500, 12)).astype(float), r.integers(-99, 99, (50, 12)).astype(float)
    high, low = x.reshape(10, 50, 12).max(axis=1), x.reshape(10, 50, 12).min(axis=1)
    assert (bounds(q, high, low) >= products(q, x).reshape(50, 10, 50).max(axis=2)).all()
