"""Requests, responses and the life cycle of an engine that serves them.

Requests are checked dataclasses that refuse unknown fields; responses are plain dictionaries. Routes are
data: any web framework can mount them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Answered, Engine
from .errors import ERRORS  # noqa: F401 (part of the interface)
from .operators.retrieve import RETRIEVERS, ResultStages
from .sources.session import Tables

class RequestError(ValueError):
    """A request that can't be served."""


class _Request:
    @classmethod
    def of(cls, data: dict[str, Any]):
        if unknown := set(data) - {f.name for f in fields(cls)}:
            raise RequestError(f"INVALID_REQUEST: unknown fields {', '.join(sorted(unknown))}")
        try:
            return cls(**data)
        except TypeError as e:
            raise RequestError(f"INVALID_REQUEST: {e}") from e


def _text(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise RequestError(f"INVALID_REQUEST: {name} is blank")
    return value.strip()


def _top_k(value: Any) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= 50:
        raise RequestError("INVALID_REQUEST: top_k must be between 1 and 50")
    return value


@dataclass(frozen=True)
class SearchRequest(_Request):
    query: str
    top_k: int = 5
    retriever: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "query", _text(self.query, "query"))
        _top_k(self.top_k)


@dataclass(frozen=True)
class AskRequest(_Request):
    question: str

    def __post_init__(self):
        object.__setattr__(self, "question", _text(self.question, "question"))


@dataclass(frozen=True)
class CompareRequest(_Request):
    query: str
    retrievers: tuple[str, ...]
    top_k: int = 5

    def __post_init__(self):
        object.__setattr__(self, "query", _text(self.query, "query"))
        names = tuple(_text(r, "a retriever") for r in self.retrievers)
        if not 1 <= len(names) <= 10 or len(set(names)) < len(names):
            raise RequestError("INVALID_REQUEST: one to ten different retrievers")
        object.__setattr__(self, "retrievers", names)
        _top_k(self.top_k)


@dataclass(frozen=True)
class Route:
    method: str
    path: str
    handler: str


ROUTES = (Route("POST", "/ask", "ask"), Route("POST", "/search", "search"), Route("POST", "/compare", "compare"), Route("GET", "/documents", "documents"), Route("GET", "/health", "health"))

HIT_FIELDS = ("chunk_id", "doc_id", "version_id", "title", "section", "source_path", "chunk_index", "text", "score", "rank")


def _rows(df: DataFrame, names: tuple[str, ...], *order: str) -> list[dict]:
    """A few rows as dictionaries: results of one request are bounded by its top_k."""
    return [r.asDict(recursive=True) for r in df.select(*[c for c in names if c in df.columns]).orderBy(*order).collect()]


class Runtime:
    """created, starting, running, stopping, stopped or failed; requests are served while running. The index
    is loaded and checked once, at the start."""

    def __init__(self, make: Callable[[], Engine]):
        self._make, self._engine, self._lock = make, None, threading.RLock()
        self.state, self.error = "created", None

    def start(self) -> None:
        with self._lock:
            if self.state == "running":
                return
            if self.state not in ("created", "stopped", "failed"):
                raise RuntimeError(f"can't start while {self.state}")
            self.state, self.error = "starting", None
            try:
                self._engine = self._make()
                _ = self._engine.index
                self.state = "running"
            except Exception as e:
                self.state, self.error, self._engine = "failed", str(e), None
                raise

    def stop(self) -> None:
        with self._lock:
            if self.state != "running":
                return
            self.state, self._engine = "stopping", None
            self.state = "stopped"

    @contextmanager
    def running(self):
        self.start()
        try:
            yield self
        finally:
            self.stop()

    @property
    def engine(self) -> Engine:
        with self._lock:
            if self.state != "running":
                raise RuntimeError(f"the runtime is {self.state}")
            return self._engine

    def _one(self, text: str) -> DataFrame:
        return self.engine.spark.createDataFrame([(1, text)], "query_id int, query string")

    def search(self, request: SearchRequest) -> dict:
        if request.retriever is not None and request.retriever not in RETRIEVERS:
            raise RequestError(f"INVALID_REQUEST: no retriever {request.retriever}")
        e = self.engine
        s = e.settings.results
        stages = ResultStages(request.top_k, s.reranking, max(s.candidate_limit, request.top_k), s.deduplicate, s.reranker)
        with Tables():
            rows = _rows(e.search(self._one(request.query), request.retriever, stages), HIT_FIELDS, "rank")
        return {"query": request.query, "retriever": request.retriever or e.settings.retriever, "results": rows}

    def compare(self, request: CompareRequest) -> dict:
        with Tables():
            hits, both, errors, status = self.engine.compare(self._one(request.query), list(request.retrievers), request.top_k)
            found = _rows(hits, ("strategy", "chunk_id", "score", "rank"), "strategy", "rank") if hits is not None else []
            overlap = _rows(both, ("chunk_id", "ranks"), "chunk_id") if both is not None else []
        by = {n: [{k: v for k, v in r.items() if k != "strategy"} for r in found if r["strategy"] == n] for n in request.retrievers if n not in errors}
        return {"query": request.query, "status": status, "results": by, "errors": errors, "overlaps": overlap}

    def ask(self, request: AskRequest) -> dict:
        with self.engine.ask(self._one(request.question)) as a:
            return self._answer(request, a)

    def _answer(self, request: AskRequest, a: Answered) -> dict:
        answer = a.answers.head().asDict(recursive=True)
        answer.pop("query_id")
        cited = _rows(a.packed.citations.where(F.col("citation_id").isin(answer["citation_ids"] or [""])), ("citation_id", "chunk_id", "doc_id", "title", "source_path", "section", "page_start", "page_end", "snippet"), "citation_id")
        return {"question": request.question, **answer, "citations": cited, "trace": a.trace.stages}

    def documents(self) -> DataFrame:
        """Documents of the index with their number of chunks: a table, since it may be large."""
        index = self.engine.index
        n = index.table("chunks").groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
        return index.table("documents").select("doc_id", "version_id", "title", "source_path").join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))

    def health(self) -> dict:
        """State, and a snapshot of what is served."""
        out = {"state": self.state, "error": self.error}
        if self.state == "running":
            m = self.engine.index.manifest
            out |= {"index_id": m.index_id, "definition": asdict(m.definition), "counts": m.counts, "runtime": self.engine.snapshot()}
        return out
