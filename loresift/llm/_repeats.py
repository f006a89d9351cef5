"""Exact search for repeated windows of fixed length, shared by the substring and suffix operators.

A window is `length` consecutive units (words or bytes) of one document. It is repeated when the same
sequence starts anywhere else. Shipping every window would move many times the input, so positions are
pruned, exactly, before anything is exchanged:

* every window owns the smallest hash among its runs of `seed` units (a winnowed anchor). Equal windows
  own equal anchors at equal offsets, so windows need comparing only where their anchors are equal;
* consecutive windows with one anchor form a *zone*. Two zones equal as a whole are all repeats; zones
  whose anchor is unique hold none. Only zones that share an anchor but differ are looked at again;
* `extended` brings those with one anchor together and extends every match both ways, unit by unit, into a
  maximal repeat. Where too many different zones share an anchor for that, and always for the suffix
  operator, `neighbours` compares aligned blocks of windows, and then single windows, in sorted order.

Each sorted level is one range exchange followed by a comparison of neighbours. Sort keys end in the row's
place, so even a key that a third of all rows share is split evenly; the first and last row of every
partition are then compared across partitions. Hashes that decide equality have 128 bits. Rows equal in id
and text share their findings, so any number of them costs no more than their own rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import ROW, arrow_map, drop, identity, kept, release, same_row, text_bytes
from ._vector import U64, SequenceHash, Words, chunks, mix, sliding_min

_UNIT = mix(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB))
_LOW = U64((1 << 24) - 1)
#: Rows that one worker sorts, at most: ranges are cut to hold about half of that.
SORTED_ROWS = 4_000_000
#: Different zones with one anchor that are extended against each other; more of them are sorted instead.
GROUP = 32


class Units:
    """The units of several documents in a row: values (64-bit), and per document its range."""

    def __init__(self, texts: list[bytes], unit: str):
        if unit == "word":
            w = Words(texts)
            self.values, self.lo, self.hi = w.hashes(), w.first[:-1], w.first[1:]
            self.lead_at, self.buf = w.starts, w.buf
        else:
            self.buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
            at = np.cumsum([0, *(len(t) + 1 for t in texts)])
            self.values, self.lo, self.hi = _UNIT[self.buf], at[:-1], at[1:] - 1
            self.lead_at = None
        self.hash = SequenceHash(self.values)
        self._padded = None

    def lead(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each unit on, as a number that sorts like the bytes."""
        if self._padded is None:
            self._padded = np.concatenate([self.buf, np.zeros(8, dtype=np.uint8)])
        at = at if self.lead_at is None else self.lead_at[at]
        out = np.zeros(len(at), dtype=U64)
        for j in range(8):
            out = (out << U64(8)) | self._padded[at + j].astype(U64)
        return (out ^ U64(1 << 63)).view(np.int64)


def smallest_places(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of x[i:i+w], the first of equal ones, for every i with a full window. Places
    are packed below the hash bits, relative to overlapping blocks, so that they fit however long x is."""
    size = int(_LOW) + 1
    out = []
    for at in range(0, len(x) - w + 1, size - w + 1):
        block = x[at : at + size]
        low = np.arange(len(block), dtype=U64)
        out.append((sliding_min((block & ~_LOW) | low, w) & _LOW).astype(np.int64) + at)
    return np.concatenate(out)


def zones_of(u: Units, length: int, seed: int):
    """Zones of every document: (document, first window, number of windows, anchor place, anchor, digest)."""
    n, width = len(u.values), length - seed + 1
    if n < length:
        return [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=U64)] * 2
    i = np.arange(n - seed + 1)
    anchors = u.hash.of(i, i + seed)
    owned = smallest_places(anchors, width)
    has = np.maximum(u.hi - u.lo - length + 1, 0)  # windows per document
    doc = np.repeat(np.arange(len(has)), has)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(has) - has, has) + np.repeat(u.lo, has)
    if not len(s):
        return [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=U64)] * 2
    a = owned[s]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])]
    p = a[new]
    digest = mix(u.hash.other(first, last + length) ^ mix((p - first).astype(U64)))
    return doc[new], first - u.lo[doc[new]], last - first + 1, p - u.lo[doc[new]], anchors[p], digest


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


ZONE = "place long, lead long, k1 long, k2 long"


def packed(at, n, off, length: int):
    """First window, number of windows and the anchor's distance from the first window as one number."""
    return (at * (length + 1) + n) * (length + 1) + off


def unpacked(place, length: int):
    rest, off = place // (length + 1), place % (length + 1)
    return rest // (length + 1), rest % (length + 1), off


def base_table(docs: DataFrame, unit: str, length: int, seed: int, extra: Callable[[list[bytes], Units], list[pa.Array]] | None, extra_schema: str) -> DataFrame:
    """One row per document with its zones, and what `extra` computes from the same pass."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            for part in chunks(texts):
                rows = [i for i, _ in part]
                u = Units([t for _, t in part], unit)
                doc, at, n, place, k1, k2 = zones_of(u, length, seed)
                here = place + u.lo[doc] if len(doc) else place
                zones = pa.StructArray.from_arrays([_signed(packed(at, n, place - at, length)), pa.array(u.lead(here)), _signed(k1), _signed(k2)], names=["place", "lead", "k1", "k2"])
                own = b.slice(rows[0], len(rows))
                cols = [own.column("doc_id"), own.column("mark"), _lists(np.bincount(doc, minlength=len(rows)), zones)]
                names = ["doc_id", "mark", "zones"]
                if extra:
                    cols += extra([t for _, t in part], u)
                    names += [x.split()[0] for x in extra_schema.split(", ")]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"{ROW}, zones array<struct<place:bigint,lead:bigint,k1:bigint,k2:bigint>>" + (f", {extra_schema}" if extra else "")
    return arrow_map(docs, run, schema)


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows whose keys are strings of 64-bit characters, one column per character:
    three-way partition on the current character, then the equal part on the next one."""
    out = np.arange(len(columns[0]))
    stack = [(0, len(out), 0)]
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2 or d == len(columns):
            continue
        rows = out[lo:hi]
        x = columns[d][rows]
        if hi - lo <= 1 << 16:  # small parts: one sort per character, then the runs of equal ones
            order = np.argsort(x, kind="stable")
            out[lo:hi], x = rows[order], x[order]
            cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            runs = np.flatnonzero(np.diff(cut) > 1)
            if d + 1 < len(columns) and len(runs):
                if len(runs) > 64:  # many short runs: sort them together by (run, rest)
                    run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                    rows = out[lo:hi]
                    out[lo:hi] = rows[np.lexsort([c[rows] for c in columns[:d:-1]] + [run])]
                else:
                    stack += [(lo + cut[r], lo + cut[r + 1], d + 1) for r in runs]
            continue
        pivot = np.median(x[:: max(1, len(x) // 9)][:9]).astype(x.dtype) if x.dtype != np.int64 else np.sort(x[:: max(1, len(x) // 9)][:9])[4]
        less, same = x < pivot, x == pivot
        more = ~(less | same)
        a, b = int(less.sum()), int(same.sum())
        out[lo:hi] = np.concatenate([rows[less], rows[same], rows[more]])
        stack += [(lo, lo + a, d), (lo + a, lo + a + b, d + 1), (lo + a + b, hi, d)]
    return out


def _ranges(rows: DataFrame, expected: int, *by: str) -> DataFrame:
    """Range partitions by sampled splitters, as many as keep each within what one worker sorts."""
    n = 2 * expected // SORTED_ROWS + 1
    return rows.repartitionByRange(n, *by) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*by)


def neighbours(rows: DataFrame, keys: list[str], what: str, expected: int) -> DataFrame:
    """Of the rows (doc_id, mark, place, *keys) those that share all but the last key with another row, with
    `full` (all keys shared with another row), `near` (a neighbour differs in the last key) and `many` (more
    than GROUP near rows, or rows of more than one partition, may share all but the last key). `expected` is
    about their number. Range partitions are split by sampled splitters over keys and place; partitions sort
    locally by multikey quicksort; their first and last rows are compared across the boundaries."""
    ranged = _ranges(rows, expected, *keys, "doc_id", "place")
    names = ["doc_id", "mark", "place", *keys]

    def run(batches):
        table = pa.Table.from_batches(found) if (found := list(batches)) else None
        if table is None or not table.num_rows:
            return
        cols = [table.column(k).to_numpy() for k in keys]
        order = multikey_quicksort(cols)
        cols = [c[order] for c in cols]
        same1 = np.ones(len(order) - 1, dtype=bool)
        for c in cols[:-1]:
            same1 &= c[1:] == c[:-1]
        same2 = same1 & (cols[-1][1:] == cols[-1][:-1])
        no = np.zeros(1, dtype=bool)
        full = np.concatenate([no, same2]) | np.concatenate([same2, no])
        apart = same1 & ~same2
        near = np.concatenate([no, apart]) | np.concatenate([apart, no])
        edge = np.zeros(len(order), dtype=bool)
        edge[[0, -1]] = True
        run_of = np.cumsum(np.concatenate([no, ~same1]))
        crowd = np.bincount(run_of, weights=near) > GROUP
        crowd[run_of[[0, -1]]] = True
        pick = np.flatnonzero(full | near | edge)
        out = table.select(names).take(pa.array(order[pick])).combine_chunks()
        for x, v in (("full", full), ("near", near), ("many", crowd[run_of]), ("edge", edge)):
            out = out.append_column(x, pa.array(v[pick]))
        yield from out.to_batches(max_chunksize=1 << 16)

    schema = f"{ROW}, place long, {', '.join(f'{k} long' for k in keys)}, full boolean, near boolean, many boolean, edge boolean"
    out = kept(arrow_map(ranged.select(*names), run, schema), what)
    edges = out.where("edge").select("*", F.count("*").over(Window.partitionBy(*keys[:-1])).alias("c1"), F.count("*").over(Window.partitionBy(*keys)).alias("c2"))
    place = ["doc_id", "mark", "place"]
    fixed = edges.select(*place, (F.col("full") | (F.col("c2") > 1)).alias("full"), (F.col("near") | (F.col("c1") > 1)).alias("near"), "many")
    both = out.where("NOT edge").select(*place, "full", "near", "many").unionByName(fixed.where("full OR near"))
    both._kept_at = out._kept_at
    return both


def _split(u: Units, base: int, at, n, off, length: int, block: int):
    """Rows of the blocks (or single windows, block 1) of the zones of one document."""
    # o: distance from a window's start to the anchor; the zone's windows have off, off-1, ..., off-n+1
    lo, hi = off - n + 1, off
    b0, b1 = lo // block, hi // block
    count = b1 - b0 + 1
    zone = np.repeat(np.arange(len(at)), count)
    b = np.arange(len(zone)) - np.repeat(np.cumsum(count) - count, count) + b0[zone]
    place = base + at[zone] + off[zone]  # of the anchor
    o_lo, o_hi = np.maximum(b * block, lo[zone]), np.minimum(b * block + block - 1, hi[zone])
    core = place - b * block  # start of the last window: the units from here on are in all of them
    core_end = core - block + 1 + length
    whole = (o_hi - o_lo + 1) == block
    if block == 1:
        k1, k2 = u.hash.of(core, core + length), u.hash.other(core, core + length)
    else:
        k1 = mix(u.hash.of(core, core_end) ^ mix(b.astype(U64)))
        first = core - block + 1
        k2 = u.hash.other(np.where(whole, first, core), np.where(whole, core + length, core_end))
        own = mix((place + np.int64(u.values.size)).astype(U64) ^ mix((zone.astype(U64) << U64(32)) + o_lo.astype(U64)))
        k2 = np.where(whole, k2, mix(k2 ^ own))
    start = place - base - o_hi  # the first window of the block in this zone
    return start, o_hi - o_lo + 1, o_hi, core, k1, k2, whole


def _around(u: Units, base: int, at, n, off, length: int, seed: int):
    """(anchor, unit values around it) of zones: one number that checks the anchor, then the units before it,
    outwards, and those after it, up to the zone's ends; and how many there are on each side."""
    side = length - seed
    place = base + at + off
    left, right = off, n - 1 + length - off - seed
    step = np.arange(side)
    before = np.where(step < left[:, None], u.values[np.maximum(place[:, None] - 1 - step, 0)], U64(0))
    after = np.where(step < right[:, None], u.values[np.minimum(place[:, None] + seed + step, len(u.values) - 1)], U64(0))
    check = u.hash.other(place, place + seed)
    sides = (left << 32 | right).astype(U64)
    return u.hash.of(place, place + seed), np.concatenate([check[:, None], sides[:, None], before, after], axis=1)


def _need(parts: DataFrame) -> DataFrame:
    """(doc_id, mark, parts): what is left to settle of every document, once for all its equal rows."""
    return parts.where("near").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("place", "many")).alias("parts"))


def _next_level(cand: DataFrame, parts: DataFrame, unit: str, length: int, block: int, seed: int = 0) -> DataFrame:
    """Block rows of all near parts, from the candidates' texts. With `seed`, only of parts that many share;
    the others give one row each, k1 being the anchor and `around` what stands around it."""
    need = _need(parts)
    joined = cand.join(need, same_row(cand, need)).select(cand["doc_id"], cand["mark"], cand["text"], need["parts"])

    def rows(b, take, place, lead, k1, k2, around):
        row = pa.array(np.concatenate(take))
        cols = [b.column("doc_id").take(row), b.column("mark").take(row), *(_signed(np.concatenate(x)) for x in (place, lead, k1, k2))]
        cols.append(pa.array(np.concatenate(around), pa.binary()) if around else pa.nulls(len(row), pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "place", "lead", "k1", "k2", "around"])

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            for chunk in chunks(texts):
                u = Units([t for _, t in chunk], unit)
                blocks, zones = [[] for _ in range(5)], [[] for _ in range(6)]
                for j, (i, _) in enumerate(chunk):
                    part, base = b.column("parts")[i].values, int(u.lo[j])
                    place, many = (part.field(c).to_numpy(zero_copy_only=False) for c in ("place", "many"))
                    if seed and not many.all():
                        one = place[~many]
                        k1, around = _around(u, base, *unpacked(one, length), length, seed)
                        none = np.zeros(len(one), dtype=np.int64)
                        wide = np.array([None, *(r.tobytes() for r in around)], dtype=object)[1:]
                        for x, v in zip(zones, (np.full(len(one), i), one, none, k1, none, wide)):
                            x.append(v)
                        place = place[many]
                    if len(place):
                        start, m, o, core, k1, k2, whole = _split(u, base, *unpacked(place, length), length, block)
                        if not whole.all():  # a partial block never equals another as a whole
                            salt = hash((b.column("doc_id")[i].as_py(), b.column("mark")[i].as_py())) & ((1 << 63) - 1)
                            k2 = np.where(whole, k2, mix(k2 ^ U64(salt)))
                        for x, v in zip(blocks, (np.full(len(start), i), packed(start, m, o, length), u.lead(core), k1, k2)):
                            x.append(v)
                if blocks[0]:
                    yield rows(b, *blocks, None)
                if zones[0]:
                    yield rows(b, *zones)

    return arrow_map(joined, run, f"{ROW}, {ZONE}, around binary")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row, how many leading values are equal."""
    differ = np.concatenate([x != y, np.ones((len(x), 1), dtype=bool)], axis=1)
    return differ.argmax(axis=1)


def extended(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, mark, at, n): the window ranges of maximal repeats among the rows (doc_id, mark, place, k1,
    around). Rows meet on their anchor; every match is extended both ways and stays if it has `length` units.
    No anchor has more than GROUP rows here."""
    side = length - seed
    rows = rows.select("k1", "doc_id", "mark", "place", "around").repartition("k1").sortWithinPartitions("k1")

    def repeats_of(t: pa.Table):
        k1, place = t.column("k1").to_numpy(), t.column("place").to_numpy()
        around = np.frombuffer(b"".join(t.column("around").to_pylist()), dtype=U64).reshape(len(k1), -1)
        at, _, off = unpacked(place, length)
        sides = around[:, 1].astype(np.int64)
        left, right, anchor = sides >> 32, sides & 0xFFFFFFFF, at + off
        found = [[], [], []]
        i, d = np.arange(len(k1)), 0
        while len(i):
            d += 1
            i = i[i + d < len(k1)]
            i = i[k1[i] == k1[i + d]]
            for p in range(0, len(i), 1 << 14):
                a = i[p : p + (1 << 14)]
                a = a[around[a, 0] == around[a + d, 0]]
                b = a + d
                back = np.minimum(_common(around[a, 2 : 2 + side], around[b, 2 : 2 + side]), np.minimum(left[a], left[b]))
                on = np.minimum(_common(around[a, 2 + side :], around[b, 2 + side :]), np.minimum(right[a], right[b]))
                n = back + seed + on - length + 1
                ok = n > 0
                for row in (a[ok], b[ok]):
                    for x, v in zip(found, (row, anchor[row] - back[ok], n[ok])):
                        x.append(v)
        if found[0]:
            row, at, n = np.unique(np.stack([np.concatenate(x) for x in found]), axis=1)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(pa.array(row)) for c in ("doc_id", "mark")), pa.array(at), pa.array(n)], names=["doc_id", "mark", "at", "n"])

    def run(batches):
        pending = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([b])])
            k1 = t.column("k1").to_numpy()
            cut = int(np.searchsorted(k1, k1[-1]))  # the last anchor's rows may go on
            if cut:
                yield from repeats_of(t.slice(0, cut))
            pending = t.slice(cut)
        if pending is not None:
            yield from repeats_of(pending)

    return arrow_map(rows, run, f"{ROW}, at long, n long")


def merged(at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit ranges covered by windows that start in [at, at+n), as disjoint sorted ranges."""
    if not len(at):
        return at, at
    order = np.argsort(at, kind="stable")
    lo, hi = at[order], np.maximum.accumulate(at[order] + n[order] - 1 + length)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new], hi[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


def repeats(docs: DataFrame, *, unit: str, length: int, seed: int, blocks: list[int], by_lead: bool, id_col: str, text_col: str, extra=None, extra_schema: str = ""):
    """Documents with repeated windows, and the table of all documents. Without `by_lead`, matches are
    extended from their anchors.

    Returns (base, found): base has (doc_id, mark, *extra) for every row; found has (doc_id, mark, text,
    parts) for the documents that hold repeated windows, parts listing ranges of window starts (at, n).
    """
    spark = docs.sparkSession
    keys = (["lead"] if by_lead else []) + ["k1", "k2"]
    own = identity(docs, id_col, text_col)
    zones = kept(base_table(own, unit, length, seed, extra, extra_schema), "zones")
    level = zones.select("doc_id", "mark", F.explode("zones").alias("z")).select("doc_id", "mark", "z.*")
    first = neighbours(level, keys, "level0", zones.agg(F.coalesce(F.sum(F.size("zones")), F.lit(0))).head()[0])
    base = kept(zones.drop("zones"), "documents")
    drop(zones)
    release(spark)
    at, n = _unpacked_columns(length)
    some = first.groupBy("doc_id", "mark").agg(F.collect_set(F.when(F.col("full"), F.struct(at, n))).alias("parts"))
    cand = kept(own.join(some, same_row(own, some)).select(own["doc_id"], own["mark"], own["text"], some["parts"]).dropDuplicates(["doc_id", "mark"]), "candidates")
    release(spark)
    parts, done = first, []
    for block in blocks:
        level = _next_level(cand, parts, unit, length, block, 0 if by_lead else seed)
        if not by_lead:
            whole = kept(level, "around")
            level = whole.where("around IS NULL")
            done.append(kept(extended(whole.where("around IS NOT NULL"), length, seed), "extended"))
        near = F.when(F.col("near") & (F.lit(by_lead) | F.col("many")), n / block + 2)
        parts = neighbours(level, keys, f"block{block}", int(parts.agg(F.coalesce(F.sum(near), F.lit(0))).head()[0]))
        drop(*([first] if block == blocks[0] else []), *([] if by_lead else [whole]))  # the next level starts from this one
        release(spark)
        done.append(parts.where("full").select("doc_id", "mark", at, n))
    more = done[0]
    for x in done[1:]:
        more = more.unionByName(x)
    more = more.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("more"))
    found = cand.join(more, same_row(cand, more), "left").select(
        cand["doc_id"], cand["mark"], cand["text"], F.concat(cand["parts"], F.coalesce(more["more"], F.expr("cast(array() as array<struct<at:bigint,n:bigint>>)"))).alias("parts")
    )
    return base, found.where(F.size("parts") > 0)


def _unpacked_columns(length: int):
    rest = F.expr(f"place DIV {length + 1}")
    return F.expr(f"place DIV {(length + 1) ** 2}").alias("at"), F.pmod(rest, F.lit(length + 1)).alias("n")
