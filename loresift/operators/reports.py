"""Reports and sinks: JSON, JSON lines and Markdown from DataFrames."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import failure_of
from ..sources.session import Tables
from .index import Manifest


@dataclass
class Trace:
    """What a run did: stages with status, milliseconds and detail. Tables that a stage stores are part of its
    detail, with the rows that the writing jobs counted."""

    run: str
    tables: Tables | None = None
    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    stages: list[dict] = field(default_factory=list)
    status: str = "running"
    failure: dict | None = None

    @contextmanager
    def stage(self, name: str):
        began, detail = time.perf_counter(), {}
        before = len(self.tables.written) if self.tables else 0
        try:
            yield detail
            status = "success"
        except Exception as e:
            status, self.status, self.failure = "error", "error", failure_of(e)
            detail["error"] = str(e)[:300]
            raise
        finally:
            if self.tables and len(self.tables.written) > before:
                detail["written"] = [dict(x) for x in self.tables.written[before:]]
            self.stages.append({"stage": name, "status": status, "latency_ms": round((time.perf_counter() - began) * 1000, 2), "detail": detail})

    def finish(self) -> dict:
        self.status = "error" if self.status == "error" else "success"
        return self.as_dict()

    def as_dict(self) -> dict:
        return {"run": self.run, "trace_id": self.trace_id, "status": self.status, "latency_ms": round(sum(x["latency_ms"] for x in self.stages), 2), "failure": self.failure, "stages": self.stages}


def _report(kind: str, status: str, **body) -> dict:
    return {"schema_version": 1, "report_type": kind, "generated_at": datetime.now(UTC).isoformat(), "status": status, **body}


def ingestion_report(manifest: Manifest) -> dict:
    """Files of a build: how many were read, and how many failed. The failures are a table of the index."""
    ok, bad = (next((x.get("rows", 0) for x in manifest.stages if x["stage"] == name), 0) for name in ("documents", "failures"))
    return _report("ingestion", manifest.status, source=manifest.definition.source_dir, candidate_count=ok + bad, succeeded_count=ok, failed_count=bad, failures=f"{manifest.tables}/failures")


def build_report(manifest: Manifest) -> dict:
    """What a build made, as counted by the jobs that wrote it, and its stages."""
    c = manifest.counts
    names = {"documents": "document_count", "chunks": "chunk_count", "vectors": "vector_count", "cache_hit": "embedding_cache_hits", "cache_miss": "embedding_cache_misses", "skipped": "skipped_existing_chunks", "blank_chunks": "empty_chunk_count"}
    return _report("index_build", manifest.status, index_id=manifest.index_id, error=manifest.error, **{said: c.get(name, 0) for name, said in names.items()}, manifest=manifest.as_dict())


def retrieval_report(request: dict, counts: dict, hits: DataFrame | None, trace: Trace, runtime: dict, text: bool = False, preview: int = 160) -> dict:
    """One search: the request, what it counted on its way, and the hits, which its top_k bounds."""
    rows = [] if hits is None else [r.asDict(recursive=True) for r in hit_report(hits, text, preview).orderBy("query_id", "rank").collect()]
    return _report("retrieval_execution", trace.status, request=request, counts=counts, runtime=runtime, results=rows, failure=trace.failure, trace=trace.as_dict())


def comparison_report(request: dict, strategies: list[dict], overlaps: list[dict], status: str, trace: Trace, runtime: dict) -> dict:
    """One comparison: what became of every strategy, and what two or more of them found."""
    return _report("retrieval_comparison", status, request=request, strategy_results=strategies, overlaps=overlaps, runtime=runtime, trace=trace.as_dict())


def hit_report(hits: DataFrame, text: bool = False, preview: int = 160) -> DataFrame:
    """Hits for a report: identity, score and rank, with a text preview only if asked for."""
    cols = [c for c in ("query_id", "chunk_id", "doc_id", "source_path", "title", "section", "score", "rank", "retrieval_rank", "rerank_score") if c in hits.columns]
    return hits.select(*cols, *([F.substring("text", 1, preview).alias("text_preview")] if text else []))


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; one file only for tables that are small by nature."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_evaluation(metrics: DataFrame, summary: DataFrame, path: str, run: dict | None = None) -> str:
    """case_results, failures and summary as JSON lines, run.json with what the run was (settings, index),
    and the Markdown page that is returned too."""
    if run is not None:
        said = metrics.sparkSession.createDataFrame([(json.dumps(run, ensure_ascii=False, default=str),)], "value string")
        said.coalesce(1).write.mode("overwrite").text(f"{path}/run.json")
    write_json(metrics, f"{path}/case_results")
    write_json(metrics.where("status <> 'success'"), f"{path}/failures")
    write_json(summary, f"{path}/summary", single=True)
    page = evaluation_page(summary)
    spark = metrics.sparkSession
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/EVALUATION.md")
    return page


def evaluation_page(summary: DataFrame) -> str:
    """A table of metrics by question type, for each experiment; the summary has a row for each of them."""
    rows = sorted((r.asDict().get("experiment") or "", r["question_type"] or "", r["metric"], r["mean"], r["n"]) for r in summary.collect())
    out = ["# Evaluation"]
    for name in dict.fromkeys(r[0] for r in rows):
        out += ["", *([f"## {name}", ""] if name else []), "| questions | metric | mean | cases |", "|---|---|---|---|"]
        out += [f"| {t or 'all'} | {m} | {'-' if v is None else f'{v:.4f}'} | {n} |" for x, t, m, v, n in rows if x == name]
    return "\n".join(out) + "\n"
