import hashlib
import random
from collections import defaultdict

import pytest

from loresift.llm.mixing import mixed, plan, schedule


def fill(sizes, weights, share, epochs):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > epochs * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def key(rows):
    return sorted((x["doc_id"], sum(p["taken"] for p in x["passes"])) for x in rows)


def plain(rows, sizes, packet=256, budget=None):
    """The mix by a loop: all packets of all queues in the order of finish time, until the budget is spent."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    packets, taken = [], [0] * len(rows)
    for rank, s in enumerate(names):
        own = sorted((md5(f"{i}:{md5(t or '')}:17"), i, len((t or "").split()), at) for at, (i, t, x) in enumerate(rows) if x == s)
        sent = 0
        for _ in range(2):
            for _, _, n, at in own:
                for a in range(0, n, packet):
                    sent += min(packet, n - a)
                    packets.append((sent / (5.0, 2.0, 1.0)[rank % 3], rank, sent, min(packet, n - a), at))
    left = int(1.5 * sum(sizes.values()) + 1e-6)
    for *_, n, at in sorted(packets):
        taken[at] += min(n, left)
        left -= min(n, left)
    return sorted((rows[at][0], n) for at, n in enumerate(taken))


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "ß", "Z", "𝒜", None, "src10", "src9"][: 3 + seed * 2]
    rows = [(i, " ".join(["w"] * r.randrange(0, r.choice([5, 40, 900]))) if r.random() > 0.05 else None, r.choice(names[:2] * 4 + names)) for i in range(400)]
    rows += [(i + 1000, t, s) for i, t, s in rows[:3]] + rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = schedule(plan(df)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for x in got:
        n = sum(p["taken"] for p in x["passes"])
        assert 0 <= n <= 2 * x["size"] and x["source_size"] == sizes[x["source"]]
        taken[x["source"]] += n
        target[x["source"]] = x["target"]
    want = fill(dict(sizes), (5, 2, 1), 1.5, 2)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 256 * len(want)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()) + 1e-6)
    assert key(got) == plain(rows, sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert key(got) == key(schedule(plan(df.repartition(7))).collect())


def test_mix_of_whole_rows(spark):
    rows = [(i, f"a b c {i}", "s" + str(i % 3), "x") for i in range(90)] + [(90, None, None, None), (91, "", "s0", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes string")
    got = mixed(df)
    assert got.columns == df.columns
    assert abs(got.count() - 135) <= 3
    assert mixed(df.limit(0)).count() == 0
    assert schedule(plan(df.limit(0))).collect() == []
