"""Source divergence audit: how far the sources of a language lie apart in their use of terms.

Terms are counted inside workers and combined by (lang, source, term); kept are those in enough documents of
their language. The kept terms of a language are dealt by hash into blocks, and every block becomes a dense
int64 tile of groups by terms (a group is a source of the language; one more row is the language itself). In a
tile all pairs of groups are compared by broadcasting, strip by strip. Partial pair matrices are summed, in the
task as long as they are small and by Spark after that, and every group keeps the heap of its largest terms,
which are merged likewise.

A tile holds some `CELLS` numbers, whatever the vocabulary and the number of sources: more terms make more
blocks. A block starts with a row that names its language's groups and totals, so nothing is broadcast.

Defined results: null text, lang and source are ''; a group without terms takes part with counts of 0; a language
that keeps no term has pairs of value 0 and no term rows; a language with one source has no pairs; repeated rows
count as documents of their own; an empty table gives no rows; other columns are not looked at. Shares
are exact as long as a group counts fewer than 9 * 10**15 terms.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import arrow_map, kept, text_bytes

LEAST_DOCS = 30
TOP = 50
CELLS = 1 << 15
UNIT, PRIOR = 10**9, 5
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased bytes: other letters are whole in UTF-8
_LONG, _HELD = 1 << 20, 200_000


def counted(text: bytes) -> Counter:
    """How often each term occurs in a whole text. The terms of long texts are not listed at once."""
    low = text.lower()
    if len(low) <= _LONG:
        return Counter(_TERM.findall(low))
    out, found = Counter(), (m.group() for m in _TERM.finditer(low))
    while part := list(islice(found, 1 << 16)):
        out.update(part)
    return out


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents that hold it."""

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out():
            for (lang, source), terms in held.items():
                n = len(terms)
                both = np.array(list(terms.values()), dtype=np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), text_bytes(b.column("text"))):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in counted(text).items():
                    if term in terms:
                        x = terms[term]
                        x[0] += n
                        x[1] += 1
                    else:
                        terms[term] = [n, 1]
                size += len(terms) - before
                if size > _HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = arrow_map(rows, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(UNIT * count / total), by long division: no product leaves 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out


class Tile:
    """The terms of one block against all groups of a language; the last row is the language itself."""

    def __init__(self, totals: np.ndarray, terms: list[str], counts: np.ndarray, vocabulary: int):
        self.terms, self.counts = terms, counts
        all_terms = PRIOR * vocabulary
        self.p = 1 + shares(counts + PRIOR, np.maximum(totals + all_terms, 1)[:, None])

    def pairs(self, into: np.ndarray, cells: int = CELLS) -> None:
        """Add the distances of all pairs of groups to a matrix, some rows at a time."""
        p = self.p[:-1]
        step = max(1, cells // max(1, p.size))
        for a in range(0, len(p), step):
            into[a : a + step] += np.abs(p[a : a + step, None, :] - p[None, :, :]).sum(axis=2)

    def largest(self, top: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        """Of every group, (-value, term) of the terms that it uses more than its language does, the largest first."""
        over = np.where(self.counts[:-1] > 0, self.p[:-1] - self.p[-1], 0)
        for g, row in enumerate(over):
            at = np.flatnonzero(row > 0)
            if len(at) > top:
                at = at[row[at] >= np.partition(row[at], len(at) - top)[len(at) - top]]
            yield g, sorted((-int(row[i]), self.terms[i].encode()) for i in at)[:top]


def _tiles(batches) -> Iterator[tuple[str, list[str], np.ndarray, list[str], np.ndarray, int]]:
    """(lang, sources, totals, terms, counts, vocabulary) of every block of a task's sorted rows."""
    key, head, terms, found = None, None, [], []

    def done():
        lang, sources, totals, vocabulary = head
        counts = np.zeros((len(sources) + 1, len(terms)), dtype=np.int64)
        at = 0
        for which, where, n in found:
            counts[pc.index_in(which, value_set=pa.array(sources)).to_numpy(zero_copy_only=False), where] = n
            at += len(which)
        counts[-1] = counts[:-1].sum(axis=0)
        return lang, sources, totals, list(terms), counts, vocabulary

    for b in batches:
        lists = b.column("uses")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        names, numbers = flat.field("source"), flat.field("n").to_numpy(zero_copy_only=False)
        langs, blocks, own, sizes = (b.column(c).to_pylist() for c in ("lang", "block", "term", "vocabulary"))
        row = 0
        while row < len(langs):
            if (langs[row], blocks[row]) != key:
                if head:
                    yield done()
                lo, hi = offsets[row], offsets[row + 1]
                sources = names.slice(lo, hi - lo).to_pylist()
                totals = numbers[lo:hi].astype(np.int64)
                key, head = (langs[row], blocks[row]), (langs[row], sources, np.append(totals, totals.sum()), sizes[row])
                terms, found = [], []
                row += 1
                continue
            end = row
            while end < len(langs) and (langs[end], blocks[end]) == key:
                end += 1
            lo, hi = offsets[row], offsets[end]
            where = np.repeat(np.arange(len(terms), len(terms) + end - row), np.diff(offsets[row : end + 1]))
            found.append((names.slice(lo, hi - lo), where, numbers[lo:hi].astype(np.int64)))
            terms += own[row:end]
            row = end
    if head:
        yield done()


_OUT = "lang string, source string, part string, item string, value long"


def _compared(top: int, cells: int):
    """Partial pair sums and heaps of a task's blocks: those of one language together, if its matrix is small."""

    def rows(lang, source, part, items, values):
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array([part] * n), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def flush(lang, sources, matrix, heaps):
        for g, source in enumerate(sources):
            if len(sources) > 1:
                yield rows(lang, source, "pair", sources[:g] + sources[g + 1 :], np.delete(matrix[g], g))
            if heaps[g]:
                yield rows(lang, source, "term", [t.decode() for _, t in heaps[g]], [-v for v, _ in heaps[g]])

    def run(batches):
        held = None
        for lang, sources, totals, terms, counts, vocabulary in _tiles(batches):
            if held and held[0] != lang:
                yield from flush(*held)
                held = None
            tile = Tile(totals, terms, counts, vocabulary)
            if len(sources) ** 2 > 4 * cells:  # strips of the matrix leave at once, so that it is never whole
                step, p = max(1, cells // len(sources)), tile.p[:-1]
                heaps = dict(tile.largest(top))
                for a in range(0, len(p), step):
                    for g in range(a, min(a + step, len(p))):
                        yield rows(lang, sources[g], "pair", sources[:g] + sources[g + 1 :], np.delete(np.abs(p - p[g]).sum(axis=1), g))
                        if heaps[g]:
                            yield rows(lang, sources[g], "term", [t.decode() for _, t in heaps[g]], [-v for v, _ in heaps[g]])
                continue
            held = held or (lang, sources, np.zeros((len(sources), len(sources)), dtype=np.int64), [[] for _ in sources])
            tile.pairs(held[2], cells)
            for g, own in tile.largest(top):
                held[3][g] = list(islice(heapq.merge(held[3][g], own), top))
        if held:
            yield from flush(*held)

    return run


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS, **columns) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: for every other source of the language the summed
    distance of the shares of all kept terms; part `term`: the `top` kept terms that the source uses more than its
    language does, with the difference of shares. Shares are smoothed parts of 10**9."""
    names = {"lang": columns.get("lang_col", "lang"), "source": columns.get("source_col", "source")}
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in names.items()]).distinct()
    by_term = term_counts(docs, **columns).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("uses"), F.sum("docs").alias("docs"))
    terms = kept(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "uses"), "terms")
    totals = terms.select("lang", F.explode("uses").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("n"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    groups = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("uses"))
    heads = kept(groups.join(vocabulary, "lang", "left").select("lang", "uses", F.coalesce("vocabulary", F.lit(0).cast("long")).alias("vocabulary")), "groups")
    most = heads.agg(F.max(F.col("vocabulary") * (F.size("uses") + 1))).first()[0] or 0
    n = max(1, -(-most // cells))
    blocks = heads.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(None).cast("string").alias("term"), "uses", "vocabulary")
    blocks = blocks.unionByName(terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("block"), "term", "uses", F.lit(None).cast("long").alias("vocabulary")))
    dealt = blocks.repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("term").asc_nulls_first())
    partial = arrow_map(dealt, _compared(top, cells), _OUT)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    best = partial.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.unionByName(best)
