"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; a bit is set if more than half of the shingle hashes have it. Fingerprints are
linked at `max_bits` or fewer differing bits. They are cut into max_bits // 2 + 1 segments, fewer than the
usual max_bits + 1, so that one segment of any linked pair differs in one bit at most. Every segment is
indexed once for each of its bits with that bit left out; linked fingerprints meet in one such variant at
least. Equal variants are brought together and their pairs verified.

Equal fingerprints are one node from the start, so copies cost nothing. A variant that many different
fingerprints share is not compared pair by pair: it is split by the variants of the bits that the first
key leaves open, in halves and then in quarters, until no group can hold more than 2**11 fingerprints; in a
group only a spanning forest of the links is kept.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer words than a
shingle form one shingle; repeated rows and repeated ids are documents of their own that share a
component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import ROW, arrow_map, identity, kept, real_id, release, row_key, text_bytes
from .components import components

BITS = 64
SEED = 42
#: Largest group that is compared within itself; larger ones are split further.
GROUP = 2048
#: Open bits with which a group can't hold more than that.
FEW = 11


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, as an unsigned number."""
    counts, n = np.zeros(BITS, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # bounded memory whatever the text's length
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text, as an unsigned number."""
    parts = text.lower().split()  # bytes.lower() maps A-Z only; split() cuts at ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(parts)) - 1 :]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): the row's key (see `_spark.row_key`) and its fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in text_bytes(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"])

    return arrow_map(identity(docs, id_col, text_col), run, f"{ROW}, fp long")


def _segments(max_bits: int, lo: int = 0, hi: int = BITS) -> list[tuple[int, int]]:
    n = max_bits // 2 + 1
    at = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return list(zip(at, at[1:]))


def _mask(lo: int, hi: int) -> int:
    return ((1 << (hi - lo)) - 1) << lo


def variant_masks(max_bits: int) -> list[tuple[int, int, int]]:
    """(lo, hi, mask) of every variant: the segment and the bits that the variant keeps."""
    return [(lo, hi, _mask(lo, hi) & ~(1 << bit)) for lo, hi in _segments(max_bits) for bit in range(lo, hi)]


def _finer(kept_mask: int, max_bits: int) -> list[int]:
    """Masks that split a group whose members agree on `kept_mask`: one-bit-out variants of segments of
    the open bits. Members that differ in at most max_bits of the open bits share one of them."""
    free = [b for b in range(BITS) if not kept_mask >> b & 1]
    n = max_bits // 2 + 1
    cut = [len(free) * i // n for i in range(n + 1)]
    out = []
    for a, b in zip(cut, cut[1:]):
        whole = sum(1 << x for x in free[a:b])
        out += [kept_mask | (whole & ~(1 << x)) for x in free[a:b]]
    return out


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph in which distinct fingerprints at most max_bits apart are
    linked: breadth-first, one row of distances at a time."""
    left = np.ones(len(fps), dtype=bool)
    out = []
    for s in range(len(fps)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[i]) <= max_bits))
            left[near] = False
            out += [(int(fps[i]), int(fps[j])) for j in near]
            queue += near.tolist()
    return out


def group_links(fps: np.ndarray, kept_mask: int, max_bits: int) -> list[tuple[int, int]]:
    """Links within one group of distinct fingerprints that agree on kept_mask, large groups split."""
    if len(fps) < 2:
        return []
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if np.bitwise_count(fps[:1] ^ fps[1:])[0] <= max_bits else []
    if len(fps) <= GROUP or BITS - kept_mask.bit_count() <= FEW:
        return forest(fps, max_bits)
    out = []
    for mask in _finer(kept_mask, max_bits):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                out += group_links(fps[order[a:b]], mask, max_bits)
    return out


def links(distinct: DataFrame, *, max_bits: int = 3) -> DataFrame:
    """(a, b): links that join every two different fingerprints at most max_bits apart, directly or by way
    of others. `distinct` has one row per fingerprint, column fp."""
    masks = variant_masks(max_bits)
    variants = F.array(*[F.struct(F.lit(i).alias("v"), F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(m))), lo).alias("k")) for i, (lo, _, m) in enumerate(masks)])
    rows = distinct.select("fp", F.explode(variants).alias("x")).select("fp", F.col("x.v").alias("v"), F.col("x.k").alias("k"))
    rows = rows.repartition("v", "k").sortWithinPartitions("v", "k")

    def run(batches):
        pending = None
        for b in batches:
            v, k, fp = (b.column(c).to_numpy() for c in ("v", "k", "fp"))
            if pending:
                v, k, fp = np.concatenate([pending[0], v]), np.concatenate([pending[1], k]), np.concatenate([pending[2], fp])
            if not len(v):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (k[1:] != k[:-1])]))
            pending = tuple(x[cut[-1] :] for x in (v, k, fp))
            yield from emit(v[: cut[-1]], fp[: cut[-1]], cut[:-1])
        if pending:
            yield from emit(pending[0], pending[2], np.zeros(1, dtype=np.int64))

    def emit(v, fp, cut):
        ends = np.concatenate([cut[1:], [len(v)]])
        size = ends - cut
        fp = fp.view(np.uint64)
        pairs = cut[size == 2]
        ok = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits]
        a, b = [fp[ok]], [fp[ok + 1]]
        for s, e in zip(cut[size > 2].tolist(), ends[size > 2].tolist()):
            got = group_links(fp[s:e], masks[v[s]][2], max_bits)
            if got:
                x = np.array(got, dtype=np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return arrow_map(rows.select("v", "k", "fp"), run, "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, *, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, its key (key, mark; see `_spark.row_key`), fp (signed), component_id, the smallest doc_id
    whose fingerprint is reachable over links (null if no row there has an id), and root, the smallest such
    fingerprint as a signed long."""
    fps = kept(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash")
    nodes = kept(fps.groupBy("fp").agg(F.min(real_id()).alias("first")), "nodes")
    found = kept(links(nodes.select("fp"), max_bits=max_bits), "simhash-links")
    release(docs.sparkSession)
    roots = components(found)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select(real_id().alias("doc_id"), F.col("doc_id").alias("key"), "mark", "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component one row stays, that with the smallest
    id; rows with a null id stay only where no other has one."""
    return keep_first(docs, near_duplicates(docs, words=words, max_bits=max_bits, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def keep_first(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `keep_one`, of given components (doc_id, key, mark, root): the row with the smallest id,
    then mark, stays. Rows equal in id and text count as one."""
    own = F.struct(F.col("doc_id").isNull(), F.col("key").alias("_id"), F.col("mark").alias("_mark"))
    chosen = found.groupBy("root").agg(F.min(own).alias("x")).select("x._id", "x._mark")
    key, mark = row_key(docs[id_col], docs[text_col])
    # the row travels whole, so that columns of the same names do not clash
    keyed = docs.select(key.alias("_id"), mark.alias("_mark"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return keyed.join(chosen, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select("row.*")
