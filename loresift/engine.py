"""The engine's entry points over batches of questions: index, search, compare, ask, evaluate."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Faults, each_case, failure
from .functions import text as T
from .operators import context as X
from .operators import evaluate as V
from .operators import generate as G
from .operators import index as I
from .operators import plan_queries as Q
from .operators import reports
from .operators import retrieve as R
from .operators.phrases import phrase_search
from .operators.reports import Trace
from .settings import Experiment, Settings
from .sources import files
from .sources.session import Tables, prepared, stored
from .sources.stores import JsonManifest


@dataclass
class Answered:
    """Everything that answering a batch of questions produced. Its tables stay until `close`."""

    plans: DataFrame
    hits: DataFrame
    packed: X.Packed
    answers: DataFrame
    trace: Trace
    tables: Tables
    faults: Faults | None = None

    def close(self) -> None:
        """Drop the tables, once what is wanted of them has been read."""
        self.tables.drop()

    def __enter__(self) -> Answered:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _checked(questions: DataFrame, faults: Faults | None = None) -> DataFrame:
    """(query_id, query) without outer white space; a blank question ends the query, or with an error channel is
    reported there."""
    text = T.strip(F.col("query"))
    empty = F.coalesce(text, F.lit("")) == ""
    if faults is not None:
        faults.report(questions.where(empty).select("query_id", failure("INVALID_QUERY", F.lit("a question is blank")).alias("failure")))
        return questions.where(~empty).select("query_id", text.alias("query"))
    blank = F.raise_error(F.lit("INVALID_QUERY: a question is blank")).cast("string")
    return questions.select("query_id", F.when(empty, blank).otherwise(text).alias("query"))


class Engine:
    """An index with the settings to use it. Questions are DataFrames of (query_id, query), one or many."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = prepared(spark), settings or Settings()
        self._index: I.Index | None = None

    def build(self, source: str) -> I.Manifest:
        s = self.settings
        source = files.allowed_directory(source, list(s.allowed))
        d = I.Definition(source, s.index.chunker, s.chunking.size, s.chunking.overlap, s.index.provider, s.index.model, s.index.dimension, tokenizer=s.tokenizer)
        self._index = None
        try:
            manifest = I.build(self.spark, source, s.index.path, d, skip_existing=s.index.skip_existing, fail_on_blank=s.index.fail_on_blank, scan=s.scan, pages=s.pages, stores=s.index.stores())
        except Exception:
            if s.reports.path:
                self._report("build.json", reports.build_report(I.Manifest.read(self.spark, s.index.path)))
            raise
        if s.reports.path:
            self._report("ingestion.json", reports.ingestion_report(manifest))
            self._report("build.json", reports.build_report(manifest))
        return manifest

    def _report(self, name: str, body: dict) -> None:
        JsonManifest.write(self.spark, self.settings.reports.path, name, body)

    @property
    def index(self) -> I.Index:
        """The index, checked once."""
        if self._index is None:
            self._index = I.load(self.spark, self.settings.index.path)
        return self._index

    def snapshot(self) -> dict:
        """What a run used: the index's identity and the settings of retrieval."""
        s, m = self.settings, self.index.manifest
        index = {"index_id": m.index_id, "schema_version": m.schema_version, "status": m.status, "definition_hash": m.definition.hash(), "document_set_hash": m.document_set_hash, "definition": asdict(m.definition), "counts": m.counts, "stores": m.stores}
        config = {"retriever": s.retriever, "tokenizer": s.tokenizer, "bm25": asdict(s.bm25), "hybrid": asdict(s.hybrid), "results": asdict(s.results), "context": asdict(s.context), "answering": asdict(s.answering), "registered": {"retrievers": list(R.RETRIEVERS), "rerankers": list(R.RERANKERS), "planners": list(Q.PLANNERS), "model_clients": list(G.LLM_CLIENTS)}}
        return {"index": index, "config": config}

    def _corpus(self, faults: Faults | None = None) -> R.Corpus:
        s = self.settings
        corpus = self.index.corpus(s.bm25, s.hybrid, s.tokenizer)
        corpus.faults = faults
        return corpus

    def search(self, questions: DataFrame, retriever: str | None = None, stages: R.ResultStages | None = None, forms: list[DataFrame] | None = None, faults: Faults | None = None, counts: R.SearchCounts | None = None) -> DataFrame:
        asked = _checked(questions) if faults is None else questions
        return R.search(self._corpus(faults), asked, retriever or self.settings.retriever, stages or self.settings.results, forms, counts)

    def phrases(self, questions: DataFrame) -> DataFrame:
        """(query_id, chunk_id, occurrences, first) of the chunks that hold each question word for word."""
        return phrase_search(self.index.table("positions"), _checked(questions), self.index.manifest.definition.tokenizer)

    def search_report(self, questions: DataFrame, retriever: str | None = None, stages: R.ResultStages | None = None, name: str = "retrieval.json") -> dict:
        """A search as a report; it is written too where reports go. A search that fails has a report of its own."""
        s, chosen = self.settings, stages or self.settings.results
        with Tables() as tables:
            trace, counts, hits = Trace("search", tables), R.SearchCounts(), None
            try:
                with trace.stage("retrieval"):
                    hits = stored(self.search(questions, retriever, chosen, counts=counts), "hits")
                trace.finish()
            except Exception:  # it stands in the trace
                pass
            request = {"queries": [r["query"] for r in questions.select("query").limit(100).collect()], "retriever": retriever or s.retriever, "top_k": chosen.top_k, "candidate_limit": chosen.fetch()}
            seen = counts.values() if hits is not None else {"candidate_count": 0, "deduplicated_count": 0, "returned_count": 0}
            body = reports.retrieval_report(request, seen, hits, trace, self.snapshot(), s.reports.text, s.reports.preview)
        if s.reports.path:
            self._report(name, body)
        return body

    def compare(self, questions: DataFrame, retrievers: list[str], top_k: int = 5):
        """(hits by strategy, overlaps, errors, status)."""
        stages = R.ResultStages(top_k=top_k)
        hits, errors, status = R.compare({n: lambda n=n: self.search(questions, n, stages) for n in retrievers})
        return hits, R.overlaps(hits) if hits is not None else None, errors, status

    def compare_report(self, questions: DataFrame, retrievers: list[str], top_k: int = 5, name: str = "comparison.json") -> dict:
        """A comparison as a report; it is written too where reports go."""
        with Tables() as tables:
            trace = Trace("compare", tables)
            with trace.stage("comparison"):
                hits, both, errors, status = self.compare(questions, retrievers, top_k)
            trace.finish()
            found = {} if hits is None else {r["strategy"]: r["count"] for r in hits.groupBy("strategy").count().collect()}
            strategies = [{"retriever": n, "status": "error" if n in errors else "success", "returned_count": found.get(n, 0), "error": errors.get(n)} for n in retrievers]
            shared = [] if both is None else [r.asDict(recursive=True) for r in both.orderBy("query_id", "chunk_id").collect()]
            request = {"queries": [r["query"] for r in questions.select("query").limit(100).collect()], "retrievers": retrievers, "top_k": top_k}
            body = reports.comparison_report(request, strategies, shared, status, trace, self.snapshot())
        if self.settings.reports.path:
            self._report(name, body)
        return body

    def plan(self, questions: DataFrame) -> DataFrame:
        a = self.settings.answering
        return Q.PLANNERS[a.planner](questions, a.max_additional) if a.planner == "rule_based" else Q.PLANNERS[a.planner](questions)

    def ask(self, questions: DataFrame, experiment: Experiment | None = None, faults: Faults | None = None) -> Answered:
        """Plan, retrieve, pack and answer. Retrieval uses the planned queries; reranking and packing use
        the questions as they were asked. With an error channel, questions at fault are reported there and
        have no answer; else a fault ends the batch."""
        s, tables = self.settings, Tables().enter()
        trace = Trace("ask", tables)
        stages = R.ResultStages(experiment.top_k, experiment.reranking, max(s.results.candidate_limit, experiment.top_k)) if experiment else s.results
        try:
            asked = _checked(questions, faults)
            with trace.stage("query_planning"):
                plans = stored(self.plan(asked), "plans")
                forms = Q.retrieval_queries(plans)
                n = s.answering.max_additional + 1
                forms = [forms.where(F.col("query_pos") == i).select("query_id", "query") for i in range(n)]
            with trace.stage("retrieval"):
                hits = stored(self.search(asked, experiment.retriever if experiment else None, stages, forms, faults), "hits")
                asked = asked if faults is None else faults.without(asked)
            with trace.stage("context_packing"):
                packed = X.assemble(hits, asked, s.context)
                segments = stored(packed.segments, "segments")
                packed = X.Packed(segments, X.citations(segments), packed.dropped, packed.estimator)
            with trace.stage("generation"):
                payloads = G.LLM_CLIENTS[s.answering.client](asked, packed, s.model, s.answering.language)
                # a model is asked once, whoever reads its answers
                answers = G.answers(stored(payloads, "payloads"), packed.citations, s.answering.invalid)
            trace.finish()
        except BaseException:
            tables.leave()
            tables.drop()
            raise
        tables.leave()
        return Answered(plans, hits, packed, answers, trace, tables, faults)

    def _case_metrics(self, cases: DataFrame, experiment: Experiment) -> DataFrame:
        faults = Faults()
        with self.ask(cases.select("query_id", "query"), experiment, faults) as a:
            used = a.packed.segments.select("query_id", "pos", F.explode("sources").alias("s")).select("query_id", "pos", "s.chunk_id", "s.doc_id", "s.source_path")
            cited = G.answer_citations(a.answers, a.packed.citations)
            metrics = V.case_metrics(cases, a.hits, used, cited, a.answers)
            return stored(V.isolated(metrics, cases, faults.rows()), "metrics")

    def evaluate(self, cases: DataFrame, experiments: dict[str, Experiment] | None = None) -> DataFrame:
        """Case metrics of every experiment over one index, with an empty review. A case at fault fails on its
        own: known faults go through the error channel, others are found by halving the batch."""

        def failed(part: DataFrame, said: dict) -> DataFrame:
            return V.failed_cases(part, F.struct(*[F.lit(said[k]).cast("string").alias(k) for k in ("failure_type", "error_code", "message")]))

        def of(e: Experiment) -> DataFrame:
            return reduce(DataFrame.unionByName, each_case(cases, lambda part: self._case_metrics(part, e), failed))

        return V.with_review(V.suite({n: lambda e=e: of(e) for n, e in self._experiments(experiments).items()}))

    def _experiments(self, experiments: dict[str, Experiment] | None = None) -> dict[str, Experiment]:
        s = self.settings
        return experiments or s.experiments or {"default": Experiment(s.retriever, s.results.top_k, s.results.reranking)}

    def run_info(self, dataset: str, experiments: dict[str, Experiment] | None = None) -> dict:
        """What an evaluation ran on, for its run.json."""
        return {"schema_version": 1, "run_id": f"run_{uuid.uuid4().hex[:12]}", "started_at": datetime.now(UTC).isoformat(), "dataset": dataset, "experiments": {n: asdict(e) for n, e in self._experiments(experiments).items()}, **self.snapshot()}
