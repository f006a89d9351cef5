"""Near-duplicates by exact Jaccard similarity of word shingles.

A text is the set of its `words`-word shingles (64-bit hashes, A-Z folded); two texts are linked if the sets
share `least` or more of their union. First come SimHash fingerprints of the sets: those that differ in `BITS` bits or
fewer meet by deletion-variant signatures (`simhash.links`), and the pairs whose whole sets are as like as that are
linked. Sets at the bound differ in some ten bits, so an exact search follows for the pairs that this has not brought
into one component, by prefixes: under any one order of all shingles,
linked sets have one in common among the first n - ceil(least * n) + 1 of each. Shingles that a sample shows to
be frequent come last in that order, so they seldom stand in a prefix; the order only decides the cost.

Equal sets are one node, so copies cost nothing. Nodes that share a prefix shingle, and whose sizes and outlines
(shingles per range of hashes; outlines differ by no more than the sets) allow the similarity, are compared by
their whole sets. In a group of more than `GROUP` nodes each is first compared with the group's centre (the
node whose outline is nearest to the mean, of many copies of one text the text itself), with the smallest and
with the next only; then the pairs that this has not brought into one component. Of a large group's pairs only
those leave the worker that sizes and outlines allow.

Defined results: as for `simhash`; texts without a word are equal to each other, fewer words than a shingle
form one shingle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import ROW, arrow_map, drop, identity, kept, real_id, release, same_row, text_bytes
from ._vector import U64, SequenceHash, Words, chunks, mix
from .components import components
from .simhash import links as fingerprint_links
from .simhash import majority

#: Differing bits up to which fingerprints are looked up, and parts into which nodes of one fingerprint are dealt.
BITS, PARTS = 3, 64
#: Groups up to this size are compared pair by pair at once.
GROUP = 8
#: One text in so many is looked at for frequent shingles; how often they occur there, and how many are kept.
SAMPLE, OFTEN, FREQUENT = 16, 2, 1 << 17
#: Ranges of hashes of which a node's outline holds the counts.
RANGES = 128
#: Places of the table of row hashes by which the texts that are needed again are picked.
PLACES = 1 << 23
_SLACK = 1e-9


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = Words([t.lower() for t in texts])
    h = SequenceHash(w.hashes())
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        at = np.arange(lo, max(lo + 1, hi - words + 1) if hi > lo else lo)
        out.append(np.unique(h.of(at, np.minimum(at + words, hi))))
    return out


def _node(s: np.ndarray) -> np.int64:
    return mix(np.array([mix(s).sum(dtype=U64) + U64(len(s))], dtype=U64)).view(np.int64)[0]


def simhash(s: np.ndarray) -> np.int64:
    """SimHash fingerprint of a set of shingles."""
    return np.array([majority(mix(s))], dtype=U64).view(np.int64)[0]


def outline(s: np.ndarray) -> bytes:
    """Shingles in each range of hashes, 255 at most."""
    return np.minimum(np.bincount((s >> U64(57)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def prefix(s: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set: by hash, but those in `last` (sorted hashes) after all others."""
    n = len(s) - math.ceil(least * len(s) - _SLACK) + 1
    if len(last) and len(s):
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:n]


def frequent(own: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of a sample of the texts."""
    some = own.where(F.pmod(F.shiftright("mark", 1), F.lit(SAMPLE)) == 0).dropDuplicates(["mark"])

    def run(batches):
        for b in batches:
            for part in chunks(text_bytes(b.column("text"))):
                s = np.concatenate(shingle_sets([t for _, t in part], words))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    often = arrow_map(some.select("text"), run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    found = [r["token"] for r in often.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()]
    return np.sort(np.array(found, dtype=np.int64).view(U64))


def _allowed(n: np.ndarray, least: float) -> np.ndarray:
    """Per row of ascending sizes, the end of the rows after it that its size allows."""
    return np.searchsorted(n, np.floor(n / least + _SLACK), side="right")


def group_pairs(n: np.ndarray, least: float, label: np.ndarray | None = None):
    """Pairs (i, j) of one group, sizes ascending, in blocks; with labels, of different ones only."""
    end = _allowed(n, least)
    for lo in range(0, len(n), 1 << 10):
        i = np.arange(lo, min(lo + (1 << 10), len(n)))
        for a in range(lo, len(n), 1 << 10):
            j = np.arange(a, min(a + (1 << 10), len(n)))
            ok = (j > i[:, None]) & (j < end[i][:, None])
            if label is not None:
                ok &= label[i][:, None] != label[j]
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x], j[y]


def _outlines(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, RANGES)


def _alike_enough(m, n, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and outlines allow the similarity, pair by pair: sets with c of m and n in common differ in
    m + n - 2c, and outlines in no more than that."""
    return np.abs(x.astype(np.int16) - y).sum(axis=1) <= (1 - least) / (1 + least) * (m + n) + _SLACK


def _grouped(rows: DataFrame, cols: list[str], fn, schema: str) -> DataFrame:
    """fn(columns, cuts) over whole groups of one token, ordered by size and node."""
    rows = rows.repartition("token").sortWithinPartitions("token", "n", "node")

    def run(batches):
        pending = None
        for b in batches:
            now = [_outlines(b.column(c)) if c == "outline" else b.column(c).to_numpy() for c in cols]
            if pending:
                now = [np.concatenate(x) for x in zip(pending, now)]
            if not len(now[0]):
                continue
            cut = np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))
            pending = [x[cut[-1] :] for x in now]
            yield from fn([x[: cut[-1]] for x in now], cut)
        if pending:
            yield from fn(pending, np.array([0, len(pending[0])]))

    return arrow_map(rows.select(*cols), run, schema)


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.zeros(0, dtype=U64)]).view(np.int64)))


def _batch(a, b, token=None):
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if token is None else pa.array(token)], names=["a", "b", "token"])


def _first_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, null): pairs to compare, of groups up to GROUP; (node, n, token): members of larger groups."""

    def fn(cols, cut):
        token, n, node = cols
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[n[two] >= least * n[two + 1] - _SLACK]
        a, b = [node[two]], [node[two + 1]]
        for s, e in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist()):
            if e - s <= GROUP:
                for i, j in group_pairs(n[s:e], least):
                    a.append(node[s + i])
                    b.append(node[s + j])
            else:
                yield _batch(node[s:e], n[s:e], token[s:e])
        if sum(map(len, a)):
            yield _batch(np.concatenate(a), np.concatenate(b))

    return _grouped(rows, ["token", "n", "node"], fn, "a long, b long, token long")


def _hub_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of large groups' members with the centre, the smallest and the next one, where outlines allow it."""

    def fn(cols, cut):
        _, n, node, outline = cols
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            x, m = outline[s:e], n[s:e]
            mean = x.mean(axis=0, dtype=np.float32)
            off = np.concatenate([np.abs(x[p : p + 4096] - mean).sum(axis=1) for p in range(0, e - s, 4096)])
            at = np.arange(e - s)
            for other in (np.full(e - s, int(off.argmin())), np.zeros(e - s, dtype=np.int64), np.maximum(at - 1, 0)):
                for p in range(0, e - s, 4096):
                    i, j = at[p : p + 4096], other[p : p + 4096]
                    ok = (i != j) & _alike_enough(m[i], m[j], x[i], x[j], least)
                    yield _batch(node[s + j[ok]], node[s + i[ok]])

    return _grouped(rows, ["token", "n", "node", "outline"], fn, "a long, b long, token long")


def _later_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of large groups' members with different labels, where outlines allow it."""

    def fn(cols, cut):
        _, n, node, label, outline = cols
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if (label[s:e] == label[s]).all():
                continue
            for i, j in group_pairs(n[s:e], least, label[s:e]):
                for p in range(0, len(i), 1 << 14):
                    x, y = s + i[p : p + (1 << 14)], s + j[p : p + (1 << 14)]
                    ok = _alike_enough(n[x], n[y], outline[x], outline[y], least)
                    if ok.any():
                        yield _batch(node[x[ok]], node[y[ok]])

    return _grouped(rows, ["token", "n", "node", "label", "outline"], fn, "a long, b long, token long")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes with equal fingerprints or with such as differ in BITS bits or fewer. Nodes of one fingerprint meet
    the smallest of their part, and the parts' smallest that of all; only these stand for it towards other fingerprints."""
    dealt = nodes.select("fp", "node", F.pmod("node", F.lit(PARTS)).alias("part"))
    parts = dealt.groupBy("fp", "part").agg(F.min("node").alias("head"))
    whole = kept(parts.groupBy("fp").agg(F.min("head").alias("first")), "fingerprints")
    found = kept(fingerprint_links(whole.select("fp"), max_bits=BITS), "simhash-links")
    one, two = (whole.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    across = found.join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = dealt.join(parts, ["fp", "part"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    heads = parts.join(whole, "fp").select(F.col("head").alias("a"), F.col("first").alias("b"))
    out = kept(across.unionByName(within).unionByName(heads).where("a != b"), "fingerprint-pairs")
    drop(whole, found)
    return out


def _possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) of different labels whose outlines allow the similarity."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("outline").alias("x"), F.col("label").alias("label_a"))
    two = nodes.select(F.col("node").alias("b"), "n", F.col("outline").alias("y"), F.col("label").alias("label_b"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, n = (b.column(c).to_numpy() for c in ("m", "n"))
            ok = _alike_enough(m, n, _outlines(b.column("x")), _outlines(b.column("y")), least)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return arrow_map(pairs.join(one, "a").join(two, "b").where("label_a != label_b").select("a", "b", "m", "n", "x", "y"), run, "a long, b long")


def _whole_sets(own: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(node, tokens) of the rows (node, doc_id, mark). A table of bits leaves most other texts out before
    the join, so that texts need not be shuffled."""
    place = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(PLACES)).alias("place")
    wanted = np.zeros(PLACES, dtype=bool)
    wanted[need.select(place).distinct().toArrow().column("place").to_numpy()] = True
    wanted = np.packbits(wanted)

    def run(batches):
        for b in batches:
            at = b.column("place").to_numpy()
            b = b.filter(pa.array((wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            if b.num_rows:
                sets = [s for part in chunks(text_bytes(b.column("text"))) for s in shingle_sets([t for _, t in part], words)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), _lists(sets)], names=["doc_id", "mark", "tokens"])

    sets = arrow_map(own.select("doc_id", "mark", "text", place), run, f"{ROW}, tokens array<long>")
    return sets.join(need, same_row(sets, need)).select("node", "tokens").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are as like as that."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("s").alias("m"), F.size("t").alias("n"), F.size(F.array_intersect("s", "t")).alias("c"))
    return both.where(F.col("c") >= F.lit(least) * (F.col("m") + F.col("n") - F.col("c")) - _SLACK).select("a", "b")


def near_copies(docs: DataFrame, *, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`near_roots` with component_id, the smallest doc_id reachable over links (null if no row there has an id)."""
    rows = near_roots(docs, words=words, least=least, id_col=id_col, text_col=text_col)
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root").select("doc_id", "key", "mark", "component_id", "root")


def near_roots(docs: DataFrame, *, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, its key (key, mark; see `_spark.row_key`) and root, the smallest node of its component.
    Nothing joins by root here, so that a component of any size is spread over all tasks."""
    own = identity(docs, id_col, text_col)
    last = frequent(own, words)

    def run(batches):
        for b in batches:
            sets = [s for part in chunks(text_bytes(b.column("text"))) for s in shingle_sets([t for _, t in part], words)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("mark"), pa.array(np.array([_node(s) for s in sets], dtype=np.int64)), pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                    pa.array(np.array([simhash(s) for s in sets], dtype=np.int64)), pa.array([outline(s) for s in sets], pa.binary()), _lists([prefix(s, last, least) for s in sets]),
                ],
                names=["doc_id", "mark", "node", "n", "fp", "outline", "prefix"],
            )

    spark = docs.sparkSession
    rows = kept(arrow_map(own, run, f"{ROW}, node long, n long, fp long, outline binary, prefix array<long>"), "shingles")
    plain = kept(rows.groupBy("node").agg(F.first(F.struct("doc_id", "mark", "n", "fp", "outline")).alias("x")).select("node", "x.*"), "nodes")
    release(spark)

    def linked(pairs, nodes):
        some = kept(_possible(pairs, nodes, least), "possible")
        release(spark)
        need = nodes.join(some.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "doc_id", "mark")
        sets = kept(_whole_sets(own, need, words), "sets")
        release(spark)
        out = kept(_verified(some, sets, least), "jaccard-links")
        drop(some, sets)
        release(spark)
        return out

    by_bits = _fingerprint_pairs(plain)
    release(spark)
    links = linked(by_bits, plain.withColumn("label", F.col("node")))
    nodes = kept(plain.drop("fp").join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")
    drop(by_bits, plain)
    release(spark)
    first = rows.groupBy("node").agg(F.first(F.struct("n", "prefix")).alias("x"))
    found = kept(_first_pairs(first.select("node", "x.n", F.explode("x.prefix").alias("token")), least), "pairs")
    release(spark)
    named = kept(rows.select("doc_id", "mark", "node"), "named")
    drop(rows)
    rest = found.where("token IS NOT NULL").select(F.col("a").alias("node"), F.col("b").alias("n"), "token")
    outlines = nodes.select("node", "outline")
    large = kept(rest.join(outlines, "node"), "large")
    links = links.unionByName(linked(found.where("token IS NULL").unionByName(_hub_pairs(large, least)), nodes))
    if large.limit(1).count():
        labelled = large.join(components(links), "node", "left").select("token", "n", "node", F.coalesce("root", "node").alias("label"), "outline")
        links = links.unionByName(linked(_later_pairs(labelled, least), nodes))
    drop(large)
    drop(found, nodes)
    roots = components(links)
    named = named.join(roots, "node", "left")
    return named.select(real_id().alias("doc_id"), F.col("doc_id").alias("key"), "mark", F.coalesce("root", "node").alias("root"))
