"""Retrieval over batches of queries: BM25, vectors, hybrid fusion, deduplication, comparison.

Queries are (query_id, query), chunks (chunk_id, text, ...), hits (query_id, chunk_id, score, rank). Ties
are broken by chunk_id, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import Faults, failure, guarded
from ..functions import text as T
from ..registry import Registry
from ..sources.session import batched, counted, rows_seen, stored
from .embed import DIMENSION, EMBEDDERS, MODEL, valid_vector

#: A side is sent to every executor only up to so many rows; beyond it joins are left to Spark.
BROADCAST_ROWS = 10_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows. Counting stops at one row more."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(rows: DataFrame, k: int | Column, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of every query, with rank. Spark prunes per partition before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@dataclass
class TextIndex:
    """Inverted index: postings (term, chunk_id, tf, dl), terms (term, df), stats (n, avgdl), one row. held, if there,
    are the postings as a row a chunk (chunk_id, terms, tfs, dls)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    held: DataFrame | None = None

    def write(self, path: str) -> None:
        """Postings are laid out by term, so that a query reads only the files its terms are in."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str) -> TextIndex:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "stats")))


#: Tokenizers of texts and questions by name: Column to Column of token arrays.
TOKENIZERS: Registry = Registry("tokenizer", regex=T.search_tokens)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _term_counts(tokens: DataFrame, wanted: frozenset) -> DataFrame:
    """(chunk_id, dl, terms, tfs) of (chunk_id, dl, tokens): how often each chunk has those of the wanted terms that it
    has, counted in the batch that holds it."""

    def run(batches):
        for b in batches:
            lists = b.column("tokens")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().dictionary_encode()
            known = np.array([t in wanted for t in flat.dictionary.to_pylist()], dtype=bool)
            codes, row = flat.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            keep = known[codes] if len(known) else np.zeros(0, dtype=bool)
            each = max(1, len(known))
            found, tf = np.unique(row[keep] * each + codes[keep], return_counts=True)
            n = np.bincount(found // each, minlength=len(sizes))
            out = [b.column("chunk_id"), b.column("dl"), _lists(n, flat.dictionary.take(pa.array(found % each))), _lists(n, pa.array(tf.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(out, names=["chunk_id", "dl", "terms", "tfs"])

    return batched(tokens, run, f"chunk_id {dict(tokens.dtypes)['chunk_id']}, dl int, terms array<string>, tfs array<long>")


def _chunk_rows(postings: DataFrame) -> DataFrame:
    """(chunk_id, terms, tfs, dls) of postings."""
    rows = postings.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("p"))
    return rows.select("chunk_id", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("term", "tf", "dl")])


def _index_of_terms(tokens: DataFrame, wanted: list[str]) -> TextIndex:
    """Index of a few terms: nothing is shuffled but what chunks of one id hold, which count as one chunk."""
    counts = stored(_term_counts(tokens.select("chunk_id", F.size("tokens").alias("dl"), "tokens"), frozenset(wanted)), "held")
    split = lambda rows: rows.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "chunk_id", F.col("p.tfs").alias("tf"), "dl")
    whole = lambda rows: rows.where(F.size("terms") > 0).select("chunk_id", "terms", "tfs", F.array_repeat("dl", F.size("terms")).alias("dls"))
    repeated = stored(counts.groupBy("chunk_id").count().where("count > 1 OR chunk_id IS NULL").select(F.col("chunk_id").alias("again")), "repeated")
    postings, held = split(counts), whole(counts)
    if repeated.limit(1).count():
        same = F.col("chunk_id").eqNullSafe(F.col("again"))
        once, more = counts.join(repeated, same, "left_anti"), split(counts.join(repeated, same, "left_semi"))
        more = stored(more.groupBy("term", "chunk_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "chunk_id", "tf", "dl"), "postings")
        postings, held = split(once).unionByName(more), whole(once).unionByName(_chunk_rows(more))
    terms = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    return TextIndex(postings, terms, stored(_statistics(counts), "stats"), held)


def _statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def text_index(chunks: DataFrame, queries: DataFrame | None = None, tokenizer: str = "regex") -> TextIndex:
    """Index of (chunk_id, text). Of given queries, an index for them alone, written once: texts are cut into
    tokens in one pass, in which the queries' terms are counted within each chunk before anything is
    shuffled; statistics still cover all chunks."""
    tokens = chunks.select("chunk_id", TOKENIZERS[tokenizer](F.col("text")).alias("tokens"))
    wanted = None if queries is None else query_terms(queries, tokenizer).select("term").distinct()
    if queries is None:
        postings = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")
        terms = postings.groupBy("term").agg(F.count("*").alias("df"))
        lengths = tokens.select(F.size("tokens").alias("dl"))
    elif len(few := wanted.limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS:
        return _index_of_terms(tokens, [r["term"] for r in few])
    else:
        # many terms meet the tokens by a shuffle: each chunk's terms are counted before it, lengths go their own way
        every = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
        postings = stored(every.join(wanted, "term", "left_semi").select("term", "chunk_id", "tf", "dl"), "postings")
        terms = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
        lengths = tokens.select(F.size("tokens").alias("dl"))
    stats = _statistics(lengths)
    return TextIndex(postings, terms, stats if queries is None else stored(stats, "stats"))


def query_terms(queries: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """(query_id, term, qtf): a term counts as often as the query has it."""
    return queries.select("query_id", F.explode(TOKENIZERS[tokenizer](F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass(frozen=True)
class BM25:
    """Parameters of the score."""

    k1: float = 1.5
    b: float = 0.75

    def of(self, n, df, tf, dl, avgdl, ln):
        """Weight of a term in a chunk, of columns or arrays."""
        idf = ln(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))

    def weight(self) -> Column:
        return self.of(*(F.col(c) for c in ("n", "df", "tf", "dl", "avgdl")), F.ln)


def bm25_scores(chunks: DataFrame, queries: DataFrame, params: BM25 = BM25(), index: TextIndex | None = None, tokenizer: str = "regex") -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with a query; without an index, by one
    for these queries."""
    index = index or text_index(chunks, queries, tokenizer)
    # stats is one row
    rated = query_terms(queries, tokenizer).join(index.terms, "term").crossJoin(F.broadcast(index.stats))
    postings, few = index.postings, rated.limit(10 * BROADCAST_ROWS + 1).count() <= 10 * BROADCAST_ROWS
    if few:
        # a chunk's postings come together before they meet the questions, so that sums over pairs of question and
        # chunk, which are many more, are not shuffled
        rated = F.broadcast(rated)
        postings = postings.join(F.broadcast(rated.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    rows = postings.join(rated, "term")
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * params.weight()).alias("score"))


#: Terms of questions up to which these go to the chunks; pairs of question and chunk that are scored at once.
RATED_ROWS, PAIRS = 10 * BROADCAST_ROWS, 1 << 18


def _first_of(found: pa.Table, k: int) -> pa.Table:
    """The k best rows (q, near, chunk_id) of every question."""
    found = found.take(pa.compute.sort_indices(found, sort_keys=[("q", "ascending"), ("near", "descending"), ("chunk_id", "ascending")], null_placement="at_start"))
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _bm25_blocks(held: DataFrame, rated: pa.Table, k: int, params: BM25, kind: str) -> DataFrame:
    """(query_id, chunk_id, near, score): of each task's chunks (chunk_id, terms, tfs, dls) the k best a question, near
    being the score that ranks. Chunks are scored against all questions block by block, and only the best stay."""
    rated = rated.sort_by("term").combine_chunks()
    asked, names = rated.column("query_id").combine_chunks().dictionary_encode(), rated.column("term").combine_chunks().dictionary_encode()
    query, number = asked.indices.to_numpy(), {t: i for i, t in enumerate(names.dictionary.to_pylist())}
    first = np.append(np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1)), len(rated))
    qtf, df, n, avgdl = (rated.column(c).to_numpy() for c in ("qtf", "df", "n", "avgdl"))
    n, avgdl, df, asked = float(n[0]), float(avgdl[0]), df[first[:-1]].astype(float), asked.dictionary
    size = len(asked)

    def blocks(b):
        """(row, question, score) of the pairs of one batch that share a term."""
        terms = b.column("terms").flatten().dictionary_encode()
        at = np.array([number.get(t, -1) for t in terms.dictionary.to_pylist()], dtype=np.int64)[terms.indices.to_numpy()] if len(terms) else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(b.column("terms").offsets.to_numpy()))
        tf, dl = (b.column(c).flatten().to_numpy() for c in ("tfs", "dls"))
        order = np.lexsort((dl, at, row))  # equal texts add up in one order
        order = order[at[order] >= 0]
        row, at, tf, dl = row[order], at[order], tf[order], dl[order]
        weight = params.of(n, df[at], tf, dl, avgdl, np.log)
        meets = first[at + 1] - first[at]
        upto = np.cumsum(np.bincount(row, weights=meets, minlength=b.num_rows))
        lo = 0
        while lo < b.num_rows:
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + PAIRS // size, int(np.searchsorted(upto, base + 4 * PAIRS, side="right"))))
            p = slice(*np.searchsorted(row, [lo, hi]))
            m = meets[p]
            place = np.repeat(first[at[p]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            cell = np.repeat((row[p] - lo) * size, m) + query[place]
            yield lo, np.bincount(cell, weights=np.repeat(weight[p], m) * qtf[place], minlength=(hi - lo) * size).reshape(hi - lo, size)
            lo = hi

    def run(batches):
        best, least = None, np.full(size, -np.inf)
        for b in batches:
            for lo, score in blocks(b):
                near = score.round(9)
                i, q = np.nonzero((score > 0) & (near >= least))
                if not len(i):
                    continue
                new = pa.table({"q": q, "near": near[i, q], "score": score[i, q], "chunk_id": b.column("chunk_id").take(pa.array(lo + i))})
                best = _first_of(new if best is None else pa.concat_tables([best, new]), k)
                q = best.column("q").to_numpy()
                last = np.flatnonzero(np.append(np.diff(q), 1))  # each question's last row
                full = last[np.bincount(q, minlength=size)[q[last]] == k]
                least[q[full]] = best.column("near").to_numpy()[full]
        if best is not None:
            best = best.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([asked.take(best.column("q")), *(best.column(c) for c in ("chunk_id", "near", "score"))], names=["query_id", "chunk_id", "near", "score"])

    return batched(held, run, f"query_id {kind}, chunk_id {dict(held.dtypes)['chunk_id']}, near double, score double")


def bm25(chunks: DataFrame, queries: DataFrame, k: int, params: BM25 = BM25(), index: TextIndex | None = None, tokenizer: str = "regex") -> DataFrame:
    """Top k hits by BM25; scores are rounded to 4 places after the ranking."""
    index = index or text_index(chunks, queries, tokenizer)
    rated = query_terms(queries, tokenizer).join(index.terms, "term").crossJoin(F.broadcast(index.stats))
    few = rated.limit(RATED_ROWS + 1).toArrow()
    # rounding first: equal texts must tie whatever order their terms were added in
    if 0 < len(few) <= RATED_ROWS:
        held = index.held or _chunk_rows(index.postings.join(F.broadcast(rated.select("term").distinct()), "term", "left_semi"))
        rows = ranked(_bm25_blocks(held, few, k, params, dict(queries.dtypes)["query_id"]), k, F.desc("near"), F.col("chunk_id"))
    else:
        rows = ranked(bm25_scores(chunks, queries, params, index, tokenizer), k, F.desc(F.round("score", 9)), F.col("chunk_id"))
    return rows.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k hits of (query_id, vector) by cosine over (chunk_id, vector), negative scores included.

    The query side is a stated batch. Up to a bounded size it is sent to all executors, where blocks of vectors
    are multiplied with it at once and each keeps its best k per query; a larger one meets the vectors in a grid
    of blocks. Every vector is scored exactly.
    """
    if (count := queries.count()) > BROADCAST_ROWS:
        return _vector_grid(vectors, queries, k, -(-count * 2 // BROADCAST_ROWS))
    batch = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).toPandas()
    ids, q = batch["query_id"].to_numpy(), _units(batch["vector"]) if len(batch) else np.zeros((0, 0))
    kinds = dict(vectors.dtypes), dict(queries.dtypes)

    def run(batches):
        for b in batches:
            if len(b) and len(q):
                yield _best(ids, q, b["chunk_id"].to_numpy(), _units(b["vector"]), k)

    rows = vectors.select("chunk_id", "vector").mapInPandas(run, f"query_id {kinds[1]['query_id']}, chunk_id {kinds[0]['chunk_id']}, score double")
    return ranked(rows, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def _units(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one as rows; zero vectors stay."""
    v = np.stack(vectors).astype(float)
    return v / np.where((size := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, size)


def _best(ids, q: np.ndarray, names: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Of every question, the k best of some vectors, and what ties with the last of them."""
    s = v @ q.T
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        near = s[:, i].round(12)  # equal vectors tie whatever the block's shape
        if len(near) > k:
            at = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
        else:
            at = np.arange(len(near))
        if len(at) > k:  # of those that tie, the smallest ids
            at = at[np.lexsort((names[at], -near[at]))[:k]]
        out_q.append(np.full(len(at), i))
        out_c.append(names[at])
        out_s.append(near[at])
    which = np.concatenate(out_q)
    return pd.DataFrame({"query_id": np.asarray(ids)[which], "chunk_id": np.concatenate(out_c), "score": np.concatenate(out_s)})


#: Vectors that a cell of the grid holds.
CELL_ROWS = 1 << 16


def _vector_grid(vectors: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """`vector_search` for many questions: both sides are dealt into blocks, and every pair of blocks is a cell that
    one task holds. Vectors are read once; each goes to one cell for every block of questions, and each question to
    one cell for every block of vectors. What leaves a cell is k rows a question."""
    kinds = dict(vectors.dtypes), dict(queries.dtypes)
    shards = max(1, -(-vectors.count() // CELL_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    left = vectors.select("chunk_id", plain, F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    right = queries.select("query_id", plain, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def cell(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        names, units = v["chunk_id"].to_numpy(), _units(v["vector"])
        parts = [_best(q["query_id"].iloc[a : a + 256], _units(q["vector"].iloc[a : a + 256]), names, units, k) for a in range(0, len(q), 256)]
        return pd.concat(parts)

    rows = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, f"query_id {kinds[1]['query_id']}, chunk_id {kinds[0]['chunk_id']}, score double")
    return ranked(rows, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def embed_queries(queries: DataFrame, provider: str = "mock", model: str = MODEL, dimension: int = DIMENSION, faults: Faults | None = None) -> DataFrame:
    """(query_id, vector) of the queries that have text. With an error channel, queries whose embedding raises or is
    no sound vector are reported there and left out."""
    rows, embed = queries.where(~T.is_blank(F.col("query"))), EMBEDDERS[provider](model, dimension)
    if faults is None:
        return rows.select("query_id", embed("query").alias("vector"))
    rows = rows.select("query_id", guarded(embed, "array<double>")("query").alias("made")).select("query_id", "made.*")
    unsound = failure("RETRIEVAL_FAILED", F.lit(f"the embedding is no finite vector of {dimension} numbers"))
    fine = F.coalesce(valid_vector(F.col("value"), dimension), F.lit(False))
    rows = stored(rows.select("query_id", F.col("value").alias("vector"), F.when(F.col("failure").isNotNull(), F.col("failure")).when(~fine, unsound).alias("failure")), "query_vectors")
    faults.report(rows.where("failure IS NOT NULL"))
    return rows.where("failure IS NULL").select("query_id", "vector")


def fuse(sources: list[tuple[str, DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of named, weighted hit lists. A repeated chunk uses up its rank but counts
    once; ties go to what was seen first, then to the smaller chunk_id."""
    if len(sources) < 2 or len({n for n, _, _ in sources}) < len(sources):
        raise ValueError("fusion needs two sources or more, with names of their own")
    rows = []
    for at, (name, hits, weight) in enumerate(sources):
        first = hits.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("rank", "score"), "rank").alias("h"))
        rows.append(first.select("query_id", "chunk_id", F.lit(at).alias("source"), F.lit(name).alias("retriever"), F.col("h.rank").alias("r"), F.col("h.score").alias("s"), (F.lit(float(weight)) / (constant + F.col("h.rank"))).alias("part")))
    merged = reduce(DataFrame.unionByName, rows).groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("score"),
        F.min(F.struct("source", "r")).alias("seen"),
        F.transform(F.array_sort(F.collect_list(F.struct("source", "retriever", F.col("r").alias("rank"), F.col("s").alias("score")))), lambda x: F.struct(x["retriever"].alias("retriever"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("signals"),
    )
    rows = ranked(merged, k, F.desc(F.round("score", 12)), F.col("seen"), F.col("chunk_id"))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "signals")


def hybrid(retrievers: dict[str, Callable[[int], DataFrame]], k: int, weights: dict[str, float] | None = None, multiplier: int = 3, constant: int = 60) -> DataFrame:
    """Fused top k of retrievers that each return their top k * multiplier."""
    return fuse([(n, f(k * multiplier), (weights or {}).get(n, 1.0)) for n, f in retrievers.items()], k, constant)


def candidates(hits: list[DataFrame]) -> DataFrame:
    """Hits of a query's several forms, in order: primary first. Adds query_pos."""
    return reduce(DataFrame.unionByName, [h.withColumn("query_pos", F.lit(i)) for i, h in enumerate(hits)])


def deduplicate(rows: DataFrame) -> DataFrame:
    """The first occurrence of every chunk, ranks renumbered."""
    own = Window.partitionBy("query_id", "chunk_id").orderBy("query_pos", "rank")
    first = rows.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("query_pos", "rank", "chunk_id")))


def with_chunks(hits: DataFrame, chunks: DataFrame, faults: Faults | None = None) -> DataFrame:
    """Hits with their chunks. A hit whose chunk is missing ends the query; with an error channel it is reported
    there, and only the hits of its own question go. Where the hits are few, only their chunks are moved."""
    hits = stored(hits, "found")
    asked = hits.select("chunk_id").distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        chunks = chunks.join(F.broadcast(asked), "chunk_id", "left_semi")
    known = chunks.withColumn("_known", F.lit(True))
    if faults is not None:
        rows = stored(hits.join(known, "chunk_id", "left"), "hits_with_chunks")
        lost = rows.where("_known IS NULL").groupBy("query_id").agg(F.min(F.col("chunk_id").cast("string")).alias("c"))
        faults.report(lost.select("query_id", failure("RETRIEVAL_FAILED", F.concat(F.lit("no chunk "), "c")).alias("failure")))
        return faults.without(rows.where("_known")).drop("_known")
    missing = F.raise_error(F.concat(F.lit("RETRIEVAL_FAILED: no chunk "), F.col("chunk_id").cast("string"))).cast("boolean")
    return hits.join(known, "chunk_id", "left").where(F.when(F.col("_known").isNull(), missing).otherwise(True)).drop("_known")


def multi_get(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by id in the caller's order (chunk_id, pos); unknown ids are left out."""
    return ids.join(chunks, "chunk_id").orderBy("pos")


def rerank(hits: DataFrame, queries: DataFrame, limit: int | None = None, tokenizer: str = "regex") -> DataFrame:
    """Lexical reranking of hits that carry text, by the original query: coverage of the query's tokens,
    density in the chunk, and a bonus for the whole phrase. Adds rerank_score and renumbers rank."""
    q = queries.select("query_id", F.array_distinct(TOKENIZERS[tokenizer](F.col("query"))).alias("_q"), F.lower(T.squeeze(F.col("query"))).alias("_phrase"))
    rows = hits.join(bounded(q), "query_id").withColumn("_t", TOKENIZERS[tokenizer](F.col("text")))
    m = F.size(F.array_intersect("_q", "_t"))
    phrase = F.when((F.col("_phrase") != "") & F.lower(T.squeeze(F.col("text"))).contains(F.col("_phrase")), 1.0).otherwise(0.0)
    score = F.when((F.size("_q") == 0) | (F.size("_t") == 0), 0.0).otherwise(F.round(m / F.size("_q") * 2.0 + m / F.sqrt(F.size("_t")) + phrase, 6))
    rows = rows.withColumn("rerank_score", score).withColumnRenamed("rank", "retrieval_rank")
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retrieval_rank", "chunk_id")))
    return (out if limit is None else out.where(F.col("rank") <= limit)).drop("_q", "_phrase", "_t")


RERANKERS: Registry = Registry("reranker", lexical=rerank)


@dataclass(frozen=True)
class ResultStages:
    """Result processing: candidates are widened for the reranker, then cut to top_k."""

    top_k: int = 3
    reranking: bool = False
    candidate_limit: int = 12
    deduplicate: bool = True
    reranker: str = "lexical"

    def __post_init__(self):
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.reranking and self.candidate_limit < self.top_k:
            raise ValueError("the candidate limit must not be below top_k")

    def fetch(self) -> int:
        return max(self.top_k, self.candidate_limit) if self.reranking else self.top_k

    def apply(self, rows: DataFrame, queries: DataFrame, tokenizer: str = "regex", seen: Observation | None = None) -> DataFrame:
        """Deduplicate, rerank by the original query, cut."""
        out = deduplicate(rows) if self.deduplicate else rows
        out = out if seen is None else counted(out, seen)
        if self.reranking:
            order = RERANKERS[self.reranker]
            out = order(out, queries, tokenizer=tokenizer) if order is rerank else order(out, queries)
        return out.where(F.col("rank") <= self.top_k)


def overlaps(hits: DataFrame) -> DataFrame:
    """Chunks that two or more strategies found, from hits with a strategy column: ranks by strategy."""
    first = hits.groupBy("query_id", "chunk_id", "strategy").agg(F.min("rank").alias("rank"))
    per = first.groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "rank")))).alias("ranks"))
    return per.where(F.size("ranks") >= 2)


def compare(strategies: dict[str, Callable[[], DataFrame]], fail_open: bool = True) -> tuple[DataFrame | None, dict[str, str], str]:
    """(hits with strategy, errors by strategy, status): strategies run here, one after the other, and fail on
    their own, whether in their plan or while they run; the status is success, partial_error or error. Who takes
    the hits without errors and status must not fail open: the first fault then ends the comparison."""
    names = [n.strip() for n in strategies]
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError("strategies need names of their own")
    found, errors = [], {}
    for name, f in zip(names, strategies.values()):
        try:
            found.append(stored(f().select("query_id", "chunk_id", "score", "rank").withColumn("strategy", F.lit(name)), "strategy"))
        except Exception as e:  # of any kind: a strategy's fault must not end the others
            if not fail_open:
                raise
            errors[name] = str(e)[:500]
    status = "success" if not errors else "partial_error" if found else "error"
    return (reduce(DataFrame.unionByName, found) if found else None), errors, status


@dataclass(frozen=True)
class Fusion:
    """How the hybrid retriever fuses vector and BM25 hits."""

    multiplier: int = 3
    constant: int = 60
    vector_weight: float = 1.0
    bm25_weight: float = 1.0

    def __post_init__(self):
        if self.multiplier <= 0 or self.constant < 0 or min(self.vector_weight, self.bm25_weight) < 0:
            raise ValueError(f"no sound fusion: {self}")

    def weights(self) -> dict[str, float]:
        return {"vector": self.vector_weight, "bm25": self.bm25_weight}


class SearchCounts:
    """Rows that a search's own job saw on its way."""

    def __init__(self):
        self.candidates, self.deduplicated, self.returned = Observation(), Observation(), Observation()

    def values(self) -> dict[str, int]:
        return {"candidate_count": rows_seen(self.candidates), "deduplicated_count": rows_seen(self.deduplicated), "returned_count": rows_seen(self.returned)}


@dataclass
class Corpus:
    """What retrievers search: chunks, their vectors, and an optional text index."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    index: TextIndex | None = None
    embedder: dict = field(default_factory=dict)
    params: BM25 = field(default_factory=BM25)
    fusion: Fusion = field(default_factory=Fusion)
    tokenizer: str = "regex"
    faults: Faults | None = None


RETRIEVERS: Registry = Registry(
    "retriever",
    bm25=lambda corpus, queries, k: bm25(corpus.chunks, queries, k, corpus.params, corpus.index, corpus.tokenizer),
    vector=lambda corpus, queries, k: vector_search(corpus.vectors, embed_queries(queries, **corpus.embedder, faults=corpus.faults), k),
    hybrid=lambda corpus, queries, k: hybrid({n: lambda m, n=n: RETRIEVERS[n](corpus, queries, m) for n in ("vector", "bm25")}, k, corpus.fusion.weights(), corpus.fusion.multiplier, corpus.fusion.constant),
)


def search(corpus: Corpus, queries: DataFrame, strategy: str = "vector", stages: ResultStages = ResultStages(), forms: list[DataFrame] | None = None, counts: SearchCounts | None = None) -> DataFrame:
    """Final hits with their chunks. `forms` are rewritten queries to search for, in order; results are
    reranked by the original ones. `counts` are filled in by the job that reads the hits."""
    found = candidates([RETRIEVERS[strategy](corpus, q, stages.fetch()) for q in (forms or [queries])])
    found = with_chunks(found, corpus.chunks, corpus.faults)
    if counts is None:
        return stages.apply(found, queries, corpus.tokenizer)
    return counted(stages.apply(counted(found, counts.candidates), queries, corpus.tokenizer, counts.deduplicated), counts.returned)
