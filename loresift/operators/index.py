"""Persistent indexes: building, manifests, integrity, loading.

An index is a folder of tables (documents, blocks, chunks, vectors, postings, terms, stats, positions, failures)
and a manifest. Tables are written to a folder of their own per build; the manifest names it and is written last, so a
reader sees a whole index or the one before. Documents, chunks and vectors lie in stores chosen by name, the
others are Parquet. What a build counts is observed by the jobs that write its tables.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files
from ..sources.session import rows_seen
from ..sources.stores import REPOSITORIES, JsonManifest, StoreError
from . import chunk as C
from . import clean as CL
from . import embed as E
from . import parse as P
from . import phrases
from . import retrieve as R

SCHEMA_VERSION = 6
DEFAULT_STORES = {"documents": "parquet", "chunks": "parquet", "vectors": "parquet"}


@dataclass(frozen=True)
class Definition:
    """What an index is made of; its hash tells indexes apart."""

    source_dir: str
    chunker: str = "section_aware"
    chunk_size: int = 600
    chunk_overlap: int = 100
    provider: str = "mock"
    model: str = E.MODEL
    dimension: int = E.DIMENSION
    metric: str = "cosine"
    tokenizer: str = "regex"

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@dataclass
class Manifest:
    """Identity, state and counts of an index."""

    definition: Definition
    document_set_hash: str
    status: str = "building"
    counts: dict[str, int] = field(default_factory=dict)
    tables: str = ""
    error: str | None = None
    schema_version: int = SCHEMA_VERSION
    stores: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_STORES))
    stages: list[dict] = field(default_factory=list)

    @property
    def index_id(self) -> str:
        return "idx_" + hashlib.sha1(f"{self.schema_version}|{self.definition.hash()}|{self.document_set_hash}".encode()).hexdigest()[:12]

    def write(self, spark: SparkSession, path: str) -> None:
        """Write beside the manifest and rename over it."""
        JsonManifest.write(spark, path, "manifest.json", self.as_dict())

    def as_dict(self) -> dict:
        return asdict(self) | {"index_id": self.index_id, "definition_hash": self.definition.hash()}

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest:
        d = JsonManifest.read(spark, path, "manifest.json")
        if d is None:
            raise StoreError(f"INDEX_NOT_FOUND: no manifest in {path}")
        if d.get("schema_version") != SCHEMA_VERSION:
            raise StoreError(f"INDEX_INCOMPATIBLE: schema version {d.get('schema_version')}")
        try:
            if not isinstance(d["counts"], dict) or not isinstance(d["definition"], dict) or not isinstance(d["stores"], dict):
                raise TypeError("a mapping is of another type")
            return cls(Definition(**d["definition"]), d["document_set_hash"], d["status"], d["counts"], d["tables"], d["error"], d["schema_version"], d["stores"], d["stages"])
        except (KeyError, TypeError) as e:
            raise StoreError(f"INVALID_CONFIG: {e}") from e


def document_set_hash(docs: DataFrame) -> str:
    """A hash of the set of (doc_id, version_id) that does not gather it: XOR and sum of row hashes, with
    the count."""
    h = [F.conv(F.substring(F.sha2(F.concat_ws(":", "doc_id", "version_id"), 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = docs.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(h)]).head()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest()


class _Build:
    """Writes the tables of a build; each job counts what it writes, and is a stage of the trace."""

    def __init__(self, spark: SparkSession, manifest: Manifest):
        self.spark, self.manifest = spark, manifest

    def put(self, name: str, df: DataFrame, **counts) -> tuple[DataFrame, dict[str, int]]:
        """Write a table; the table as it is stored, and the rows and `counts` that the job saw."""
        seen, at, began = Observation(), f"{self.manifest.tables}/{name}", time.perf_counter()
        store = REPOSITORIES[name][self.manifest.stores[name]] if name in self.manifest.stores else REPOSITORIES["documents"]["parquet"]
        try:
            store.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), at)
        except Exception as e:
            self.manifest.stages.append({"stage": name, "status": "error", "latency_ms": _ms(began), "error": str(e)[:300]})
            raise
        found = {"rows": rows_seen(seen), **{k: seen.get.get(k, 0) for k in counts}}
        self.manifest.stages.append({"stage": name, "status": "success", "latency_ms": _ms(began), **found})
        return store.read(self.spark, at), found


def _ms(began: float) -> float:
    return round((time.perf_counter() - began) * 1000, 2)


def build(spark: SparkSession, source_dir: str, path: str, definition: Definition | None = None, *, skip_existing: bool = True, fail_on_blank: bool = True, scan: files.Scan = files.Scan(), pages: CL.PageCleaning = CL.PageCleaning(), stores: dict[str, str] | None = None) -> Manifest:
    """Load, parse, chunk and embed a directory into an index. Vectors of an earlier build of the same
    definition are kept; texts embedded before come from its cache. On error the manifest says failed."""
    definition = definition or Definition(source_dir)
    stores = DEFAULT_STORES | (stores or {})
    for name, kind in stores.items():
        _ = REPOSITORIES[name][kind]
    raw, bad = files.load(spark, source_dir, scan)
    docs, blocks, worse = P.parse(raw, pages)
    manifest = Manifest(definition, "", tables=f"{path}/build-{uuid.uuid4().hex}", stores=stores)
    work = _Build(spark, manifest)
    try:
        before = Manifest.read(spark, path)
    except StoreError:
        before = None
    try:
        failures, failed = work.put("failures", bad.unionByName(worse))
        if scan.fail_fast and failed["rows"]:
            first = failures.orderBy("source_path").head()
            raise files.SourceError(f"{first['error_code']}: {first['source_path']}: {first['error_message']}")
        docs, documents = work.put("documents", docs)
        blocks, _ = work.put("blocks", blocks)
        manifest.document_set_hash = document_set_hash(docs)
        manifest.write(spark, path)
        chunks = C.CHUNKERS[definition.chunker](docs, C.Chunking(definition.chunk_size, definition.chunk_overlap), blocks)
        empty = Observation()
        chunks = chunks.observe(empty, F.count_if(T.is_blank(F.col("text"))).alias("blank"))
        chunks, cut = work.put("chunks", E.without_blank(chunks, fail_on_blank))
        vectors = _vectors(spark, chunks, before, definition, skip_existing)
        origins = {k: F.count_if(F.col("origin") == k) for k in ("skipped", "cache_hit", "cache_miss")}
        vectors, made = work.put("vectors", vectors, **origins)
        began = time.perf_counter()
        R.text_index(chunks, tokenizer=definition.tokenizer).write(manifest.tables)
        phrases.write(phrases.positional_index(chunks, definition.tokenizer), f"{manifest.tables}/positions")
        manifest.stages.append({"stage": "postings", "status": "success", "latency_ms": _ms(began)})
        manifest.counts = {"documents": documents["rows"], "chunks": cut["rows"], "vectors": made["rows"], "failures": failed["rows"], **{k: made[k] for k in origins}, "blank_chunks": empty.get.get("blank", 0)}
        check(Index(spark, manifest))
        manifest.status = "ready"
        manifest.write(spark, path)
        return manifest
    except Exception as e:
        manifest.status, manifest.error = "failed", str(e)[:500]
        manifest.write(spark, path)
        raise


def _vectors(spark, chunks, before, definition, skip_existing):
    same = before is not None and before.status == "ready" and (before.definition.provider, before.definition.model, before.definition.dimension) == (definition.provider, definition.model, definition.dimension)
    rows = chunks.select("chunk_id", "doc_id", "version_id", "source_path", "title", "section", "text")
    return reused(rows, Index(spark, before).table("vectors") if same else None, definition, skip_existing)


def reused(chunks: DataFrame, old: DataFrame | None, definition: Definition, skip_existing: bool = True) -> DataFrame:
    """Vectors of all chunks (chunk_id, text, ...), with where they came from as `origin`: chunks that the old
    vectors have are skipped, texts that they have are cache hits, and only the others are embedded."""
    schema = "provider string, model_name string, dimension int, text_hash string, vector array<double>"
    cache = old.select("provider", "model_name", "dimension", "text_hash", "vector") if old is not None else chunks.sparkSession.createDataFrame([], schema)
    kept, rows = None, chunks
    if old is not None and skip_existing:
        known = old.select("chunk_id", "text_hash", "vector")
        kept = rows.join(known, "chunk_id").withColumn("origin", F.lit("skipped"))
        rows = rows.join(known, "chunk_id", "left_anti")
    made = E.with_cache(rows, cache, definition.provider, definition.model, definition.dimension)
    made = made.withColumn("origin", F.when(F.col("cache_hit"), "cache_hit").otherwise("cache_miss")).drop("cache_hit")
    out = made if kept is None else made.unionByName(kept)
    return out.drop("text").withColumns({"provider": F.lit(definition.provider), "model_name": F.lit(definition.model), "dimension": F.lit(definition.dimension)})


@dataclass
class Index:
    """An index's tables, read when they are asked for."""

    spark: SparkSession
    manifest: Manifest

    def table(self, name: str) -> DataFrame:
        store = REPOSITORIES[name][self.manifest.stores[name]] if name in self.manifest.stores else REPOSITORIES["documents"]["parquet"]
        return store.read(self.spark, f"{self.manifest.tables}/{name}")

    def corpus(self, params: R.BM25 = R.BM25(), fusion: R.Fusion = R.Fusion(), tokenizer: str | None = None) -> R.Corpus:
        """What retrievers search. Of another tokenizer than the index's, postings are made for the questions."""
        d = self.manifest.definition
        tokenizer = tokenizer or d.tokenizer
        postings = R.TextIndex.read(self.spark, self.manifest.tables) if tokenizer == d.tokenizer else None
        return R.Corpus(self.table("chunks"), self.table("vectors"), postings, {"provider": d.provider, "model": d.model, "dimension": d.dimension}, params, fusion, tokenizer)


def copied(index: Index, path: str, stores: dict[str, str]) -> Manifest:
    """The same index in another folder, its documents, chunks and vectors in other stores."""
    old = index.manifest
    new = Manifest(old.definition, old.document_set_hash, "building", dict(old.counts), f"{path}/build-{uuid.uuid4().hex}", stores=old.stores | stores)
    work = _Build(index.spark, new)
    for name in (*DEFAULT_STORES, "blocks", "failures", "postings", "terms", "stats", "positions"):
        work.put(name, index.table(name))
    check(Index(index.spark, new))
    new.status = old.status
    new.write(index.spark, path)
    return new


def faults(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """(fault, id) of everything that does not fit together: repeated ids, orphans, other versions, changed
    metadata, bad vectors."""

    def said(rows, what, key):
        return rows.select(F.lit(what).alias("fault"), F.col(key).cast("string").alias("id"))

    twice = [said(t.groupBy(k).count().where("count > 1"), f"a repeated {k} in {n}", k) for n, t, k in (("documents", docs, "doc_id"), ("chunks", chunks, "chunk_id"), ("vectors", vectors, "chunk_id"))]
    orphans = [
        said(chunks.join(docs.select("doc_id"), "doc_id", "left_anti"), "a chunk without its document", "chunk_id"),
        said(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "a vector without its chunk", "chunk_id"),
        said(chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti"), "a chunk without its vector", "chunk_id"),
    ]
    v = docs.select("doc_id", F.col("version_id").alias("_v"), F.col("content_hash").alias("_h"))
    drift = said(chunks.join(v, "doc_id").where(~F.col("version_id").eqNullSafe(F.col("_v")) | ~F.col("content_hash").eqNullSafe(F.col("_h"))), "a chunk of another version", "chunk_id")
    shared = [c for c in ("doc_id", "version_id", "source_path", "title", "section") if c in vectors.columns and c in chunks.columns]
    own = vectors.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in shared])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared], F.lit(False))
    changed = said(chunks.join(own, "chunk_id").where(differs), "a vector with other metadata than its chunk", "chunk_id")
    bad = said(vectors.where(~F.coalesce(E.valid_vector(F.col("vector"), dimension), F.lit(False))), "a vector of another dimension or not finite", "chunk_id")
    return reduce(DataFrame.unionByName, [*twice, *orphans, drift, changed, bad])


def check(index: Index) -> None:
    """Refuse an index whose counts or contents do not fit."""
    t = {n: index.table(n) for n in ("documents", "chunks", "vectors")}
    for n, df in t.items():
        if (have := df.count()) != index.manifest.counts.get(n):
            raise StoreError(f"INDEX_FAILED: {have} {n}, the manifest says {index.manifest.counts.get(n)}")
    if document_set_hash(t["documents"]) != index.manifest.document_set_hash:
        raise StoreError("INDEX_FAILED: the documents are not those of the manifest")
    found = faults(t["documents"], t["chunks"], t["vectors"], index.manifest.definition.dimension).limit(3).collect()
    if found:
        raise StoreError("INDEX_FAILED: " + "; ".join(f"{r['fault']} ({r['id']})" for r in found))


def load(spark: SparkSession, path: str, expected: Definition | None = None) -> Index:
    """An index that is ready, fits the expected definition, and is whole."""
    manifest = Manifest.read(spark, path)
    if manifest.status != "ready":
        raise StoreError(f"INDEX_INCOMPATIBLE: the index is {manifest.status}")
    if expected is not None and (odd := [k for k, v in asdict(expected).items() if getattr(manifest.definition, k) != v]):
        raise StoreError(f"INDEX_INCOMPATIBLE: other {', '.join(odd)}")
    index = Index(spark, manifest)
    check(index)
    return index
