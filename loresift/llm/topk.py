"""Exact top-k search by inner product, block at a time.

Vectors become integers, floor(scale * x). Rows are brought into an order in which like ones are close (by the
nearest of some pivots), cut into blocks of `BLOCK` rows, and stored: a block is its forward index (ids and a matrix
of the smallest type that holds it) with the largest and smallest weight of every dimension. Consecutive blocks
form shards, which a task holds whole.

A query's bound on a block is the sum over dimensions of the largest product that any row of it could have. In a
shard a query visits blocks by falling bound, scores them through their forward indexes, and ends where the bound is
below its k-th best score; queries that visit the same block in the same round are scored by one matrix product.
Every query visits the shard that holds itself first; the k-th score found there is the limit with which it enters
the others, where it skips all that can't reach it. Blocks whose bound equals the limit are still scored, since ties
go to smaller ids. Results of shards are merged by Spark.

Scores are exact: products run in single or double precision only where the norms prove that no partial sum leaves
the integers these hold, else in Python integers.

Defined results: rows whose vector or id is null, or whose vector holds a null, a NaN, an infinity or a component
that the scale makes infinite, take no part; missing components of a shorter vector count as zero; a query never
meets rows with its own id; rows equal in id and vector are one query, but each of them is a candidate; scores that
leave 64 bits become the nearest that fit; an empty table, or one without queries, gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import arrow_map, kept

SCALE = 64
TOP = 20
BLOCK = 512
SHARD_ROWS = 1 << 17
PIVOTS = 64
_QUERIES = 2048
_TYPES = ("i1", "i2", "i4", "f8")  # a floor of a double is a double
_LIMITS = (1 << 7, 1 << 15, 1 << 31)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def packed(v: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of whole numbers that are given as doubles."""
    most = float(np.abs(v).max(initial=0))
    kind = next((t for t, end in zip(_TYPES, _LIMITS) if most < end), "f8")
    return kind, np.ascontiguousarray(v, dtype=kind).tobytes()


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers given as doubles, as int64 (held within its limits)."""
    # a partial sum, in whatever order, is an integer of at most the product of the norms
    most = 1.001 * np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    found = whole(a).dot(whole(b).T)
    return np.array([[min(max(int(v), _LEAST), _MOST) for v in row] for row in found], dtype=np.int64).reshape(len(a), len(b))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of every query and block, what no row of the block can exceed; a little more where doubles round."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        room = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
        return np.where(room < 1 << 52, out, np.inf)


class Shard:
    """Blocks that a task holds: forward indexes, and the extremes of their dimensions."""

    def __init__(self, blocks: list[tuple[np.ndarray, str, int, bytes]]):
        self.blocks = blocks
        self.width = max((w for _, _, w, _ in blocks), default=0)
        part = [self.rows(i) for i in range(len(blocks))]
        self.high = np.array([p.max(axis=0) for p in part]).reshape(len(blocks), self.width)
        self.low = np.array([p.min(axis=0) for p in part]).reshape(len(blocks), self.width)

    def rows(self, i: int) -> np.ndarray:
        _, kind, width, data = self.blocks[i]
        m = np.frombuffer(data, dtype=kind).reshape(-1, width) if width else np.zeros((len(self.blocks[i][0]), 0))
        return np.pad(m.astype(np.float64), ((0, 0), (0, self.width - width)))

    def search(self, q: np.ndarray, ids: np.ndarray, limit: np.ndarray, top: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Of every query, (scores, ids) of its best rows here, none of them below its limit; and how many
        pairs of query and block were scored."""
        width = max(self.width, q.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))[:, : self.width]  # what the shard hasn't adds nothing
        bound = bounds(q, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(q)
        limit, on, scored = limit.copy(), np.arange(len(q)), 0
        for turn in range(len(self.blocks)):
            block = order[on, turn]
            open_ = bound[on, block] >= limit[on]
            on, block = on[open_], block[open_]  # bounds fall, so a query that ends here is done
            if not len(on):
                break
            scored += len(on)
            by = np.argsort(block, kind="stable")
            for part in np.split(on[by], np.flatnonzero(np.diff(block[by])) + 1):
                i = order[part[0], turn]
                own = self.blocks[i][0]
                score = products(q[part], self.rows(i))
                hit = (score >= limit[part][:, None]) & (own[None, :] != ids[part][:, None])
                for k in np.flatnonzero(hit.any(axis=1)):
                    n, at = part[k], np.flatnonzero(hit[k])
                    s, v = np.concatenate([best[n][0], score[k, at]]), np.concatenate([best[n][1], own[at]])
                    keep = np.lexsort((v, ~s))[:top]  # ~s falls as s rises, also at the ends of 64 bits
                    best[n] = s[keep], v[keep]
                    if len(keep) == top:
                        limit[n] = max(limit[n], s[keep[-1]])
        return best, scored


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, their components multiplied by `scale`."""
    v = F.transform(vectors[vector_col].cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # fractions are cut in numpy, whose floor of a double stays a double
    return vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fit)


def _components(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), np.floor(column.values.to_numpy(zero_copy_only=False)) + 0.0  # no -0
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _nearest(pivots: np.ndarray):
    """Adds to each row its packed vector and the number of its nearest pivot."""

    def run(batches):
        for b in batches:
            found = [packed(x) for x in _components(b.column("v"))]
            m = matrix([x[: pivots.shape[1]] for x in _components(b.column("v"))], pivots.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                near = np.argmax(np.nan_to_num(m @ pivots.T - 0.5 * (pivots * pivots).sum(axis=1)), axis=1) if len(pivots) else np.zeros(len(m))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([k for k, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary()), pa.array(near.astype(np.int32))], names=["id", "kind", "data", "near"])

    return run


def _blocks(size: int):
    """Cuts a task's sorted rows into blocks; a task's blocks are a shard. Queries follow as rows of their own."""

    def run(batches):
        shard, ids, rows = TaskContext.get().partitionId(), [], []

        def out():
            kind, data = packed(m := matrix(rows, max(map(len, rows))))
            return stored([shard], [np.array(ids, dtype="i8").tobytes()], [kind], [m.shape[1]], [data], [None])

        for b in batches:
            asked = b.filter(b.column("asked"))
            if n := len(asked):
                yield stored([shard] * n, [None] * n, asked.column("kind"), [None] * n, asked.column("data"), asked.column("id"))
            for id_, kind, data in zip(*(b.column(c).to_pylist() for c in ("id", "kind", "data"))):
                ids.append(id_)
                rows.append(np.frombuffer(data, dtype=kind))
                if len(rows) == size:
                    yield out()
                    ids, rows = [], []
        if rows:
            yield out()

    def stored(*columns):
        types = [pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "ids", "kind", "width", "data", "id"])

    return run


def _searched(top: int):
    """A task's rows are shards, each followed by the queries that visit it."""

    def answer(shard, waiting):
        ids = np.array([w[0] for w in waiting], dtype=np.int64)
        vectors = [np.frombuffer(w[2], dtype=w[1]) for w in waiting]
        limit = np.array([_LEAST if w[3] is None else w[3] for w in waiting], dtype=np.int64)
        best, _ = shard.search(matrix(vectors, max(map(len, vectors))), ids, limit, top)
        arrays = [pa.array([x.tolist() for x in col], pa.list_(pa.int64())) for col in zip(*best)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([w[1] for w in waiting]), pa.array([w[2] for w in waiting], pa.binary()), *arrays], names=["query_id", "kind", "data", "scores", "ids"])

    def run(batches):
        number, blocks, shard, waiting = None, [], None, []
        for b in batches:
            for own, ids, kind, width, data, id_, limit in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "kind", "width", "data", "id", "limit"))):
                if own != number:
                    if waiting:
                        yield answer(shard, waiting)
                    number, blocks, shard, waiting = own, [], None, []
                if ids is not None:
                    blocks.append((np.frombuffer(ids, dtype="i8"), kind, width, data))
                    continue
                shard = shard or Shard(blocks)
                waiting.append((id_, kind, data, limit))
                if len(waiting) == _QUERIES:
                    yield answer(shard, waiting)
                    waiting = []
        if waiting:
            yield answer(shard, waiting)

    return run


_STORED = "shard int, ids binary, kind string, width int, data binary, id long"
_HITS = "query_id long, kind string, data binary, scores array<long>, ids array<long>"


def _visit(blocks: DataFrame, queries: DataFrame, shards: int, top: int) -> DataFrame:
    """Hits of queries (shard, kind, data, id, limit) in the shards that they name."""
    null = lambda kind: F.lit(None).cast(kind)
    both = blocks.withColumn("limit", null("long")).unionByName(queries.withColumns({"ids": null("binary"), "width": null("int")}))
    return arrow_map(both.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first()), _searched(top), _HITS)


def top_products(vectors: DataFrame, is_query: Column, *, top: int = TOP, scale: int = SCALE, block: int = BLOCK, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of every row for which `is_query` (a condition on `id`) holds, the `top` others
    with the largest inner products. At most `pivots` rows, of the smallest hashes of their ids, are taken as
    pivots; they decide how rows are ordered, not which are found."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale, id_col, vector_col)
    sample = _components(rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").toArrow().column("v").combine_chunks())
    coded = arrow_map(rows, _nearest(np.clip(matrix(sample, max(map(len, sample), default=0)), -1e100, 1e100)), "id long, kind string, data binary, near int")
    coded = kept(coded.select("*", F.coalesce(is_query, F.lit(False)).alias("asked"), F.rand(17).alias("salt")), "vectors")
    n = coded.count()
    # the last key parts rows that are equal in all others
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-n // block)), -(-n // shard_rows))
    dealt = coded.repartitionByRange(parts, "near", "id", "salt").sortWithinPartitions("near", "id")
    table = kept(arrow_map(dealt, _blocks(block), _STORED), "blocks")
    blocks, asked = table.where(F.col("ids").isNotNull()), table.where(F.col("ids").isNull())
    shards = 1 + (table.agg(F.max("shard")).first()[0] or 0)
    queries = asked.groupBy("id", "kind", "data").agg(F.min("shard").alias("home"))
    near = kept(_visit(blocks, queries.withColumnRenamed("home", "shard").withColumn("limit", F.lit(None).cast("long")), shards, top), "near")
    limits = near.select(F.col("query_id").alias("id"), "kind", "data", F.get("scores", F.lit(top - 1)).alias("limit"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    far = _visit(blocks, queries.join(limits, ["id", "kind", "data"]).select("id", "kind", "data", "limit", F.explode(others).alias("shard")), shards, top)
    hits = near.unionByName(far).select("query_id", "kind", "data", F.explode(F.arrays_zip("scores", "ids")).alias("hit"))
    rank = F.row_number().over(Window.partitionBy("query_id", "kind", "data").orderBy(F.desc("hit.scores"), "hit.ids"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
