"""Batches in which single cases fail, and what requests leave behind."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loresift import __main__ as cli
from loresift.engine import Engine
from loresift.errors import Faults, each_case, failure_of, guarded
from loresift.operators import embed as E
from loresift.operators import evaluate as V
from loresift.operators import generate as G
from loresift.operators import retrieve as R
from loresift.service import AskRequest, CompareRequest, Runtime, SearchRequest
from loresift.settings import Experiment, Settings, SettingsError
from loresift.sources.session import Tables, stored

RAISED = {"disk": OSError("no disk"), "type": TypeError("no text"), "value": ValueError("no value"), "run": RuntimeError("no luck"), "code": ValueError("GENERATION_FAILED: no model")}


def flaky(model, dimension):
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            for word, error in RAISED.items():
                if f"fault {word}" in t:
                    raise error
            return [1.0] if "fault short" in t else E.hash_vector(t, model, dimension)

        return texts.map(one)

    return embed


def losing(corpus, queries, k):
    """BM25 that finds a chunk which isn't there for one question."""
    lost = queries.where(F.col("query").contains("fault lost")).select("query_id", F.lit("zz").alias("chunk_id"), F.lit(9.0).alias("score"), F.lit(1).alias("rank"))
    return R.RETRIEVERS["vector"](corpus, queries, k).unionByName(lost)


def raising(corpus, queries, k):
    """Ends the whole job at one question."""
    bad = F.col("query").contains("fault run") & F.raise_error(F.lit("a fault that no step knows")).cast("boolean")
    return R.RETRIEVERS["bm25"](corpus, queries.where(F.when(F.col("query").contains("fault run"), bad).otherwise(True)), k)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("faults")
    (d / "raw").mkdir()
    for name, text in (("a", "Reciprocal rank fusion merges lists of hits."), ("b", "A budget of tokens limits the context."), ("c", "Vectors are compared by cosine.")):
        (d / "raw" / f"{name}.md").write_text(f"# {name}\n\n{text}\n")
    E.EMBEDDERS.register("flaky", flaky, replace=True)
    R.RETRIEVERS.register("losing", losing, replace=True)
    R.RETRIEVERS.register("raising", raising, replace=True)
    settings = Settings.of({"allowed": [str(d)], "retriever": "bm25", "index": {"path": f"file://{d}/index", "provider": "flaky"}, "reports": {"path": f"file://{d}/reports", "text": True, "preview": 12}})
    out = Engine(spark, settings)
    out.build(str(d / "raw"))
    out.folder = d
    return out


def cases(spark, texts):
    return spark.createDataFrame([(i, t, "plain", [], False) for i, t in enumerate(texts)], "query_id int, query string, question_type string, expected_doc_ids array<string>, expected_abstention boolean")


def test_each_fault_fails_its_own_case(spark, engine):
    texts = ["rank fusion", *[f"fault {w}" for w in RAISED], "fault lost", "fault short", " ", "tokens limit", None, "cosine"]
    got = {r["query_id"]: r for r in engine.evaluate(cases(spark, texts), {"x": Experiment("losing", 2)}).collect()}
    said = {texts[i]: (r["status"], r["failure"] and r["failure"]["failure_type"]) for i, r in got.items()}
    assert said == {
        "rank fusion": ("success", None), "tokens limit": ("success", None), "cosine": ("success", None),
        "fault disk": ("error", "infrastructure"), "fault type": ("error", "contract"), "fault value": ("error", "validation"), "fault run": ("error", "runtime"),
        "fault code": ("error", "generation_failed"), "fault lost": ("error", "retrieval_failed"), "fault short": ("error", "retrieval_failed"), " ": ("error", "invalid_query"), None: ("error", "invalid_query"),
    }
    assert got[0]["abstention_accuracy"] == 1.0 and got[1]["abstention_accuracy"] is None and got[1]["review"] is None
    assert "no chunk zz" in got[6]["failure"]["message"] and got[1]["failure"]["message"].endswith("no disk")


def test_a_fault_that_no_step_knows_is_found_by_halving(spark, engine):
    texts = ["rank fusion", "fault run", "tokens limit", "cosine", "vectors"]
    rows = engine.evaluate(cases(spark, texts), {"x": Experiment("raising", 2), "y": Experiment("bm25", 2)})
    got = {(r["experiment"], r["query_id"]): r for r in rows.collect()}
    assert len(got) == 10 and [k for k, r in got.items() if r["status"] == "error"] == [("x", 1)]
    assert "a fault that no step knows" in got["x", 1]["failure"]["message"] and got["x", 1]["failure"]["failure_type"] == "runtime"
    assert {r["failure_type"]: r["n"] for r in V.failure_counts(rows).collect()} == {"runtime": 1}
    ok = V.summary(rows).where("question_type IS NULL AND metric = 'abstention_accuracy'").collect()
    assert {r["experiment"]: r["n"] for r in ok} == {"x": 4, "y": 5}


def test_an_experiment_that_fails_whole_costs_few_runs(spark, engine):
    runs = []

    def run(part):
        runs.append(1)
        raise KeyError("no such retriever")

    rows = each_case(cases(spark, ["q"] * 500), run, lambda part, said: V.failed_cases(part, F.struct(*[F.lit(said[k]).cast("string").alias(k) for k in ("failure_type", "error_code", "message")])), probes=5)
    assert sum(r.count() for r in rows) == 500 and len(runs) <= 12
    got = engine.evaluate(cases(spark, ["rank", "cosine"]), {"none": Experiment("none", 2), "bm25": Experiment("bm25", 2)}).collect()
    assert sorted((r["experiment"], r["status"]) for r in got) == [("bm25", "success")] * 2 + [("none", "error")] * 2


def test_kinds_of_faults():
    assert failure_of(FileNotFoundError("x"))["failure_type"] == "infrastructure"
    assert failure_of(UnicodeDecodeError("utf-8", b"x", 0, 1, "bad"))["failure_type"] == "validation"
    assert failure_of(ZeroDivisionError("x")) == {"failure_type": "runtime", "error_code": None, "message": "x"}
    assert failure_of(ValueError("job aborted\nPythonException: INDEX_FAILED: a chunk is blank\n at x"))["failure_type"] == "index_failed"
    worker = "An exception was thrown from the Python worker.\nTraceback (most recent call last):\n  File 'x'\nTypeError: not a text\n"
    assert failure_of(RuntimeError(worker)) == {"failure_type": "contract", "error_code": None, "message": "not a text"}


def test_guarded_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "fault value", "fault disk", "good"])], "i int, t string").repartition(1)
    got = {r["i"]: r["g"] for r in rows.select("i", guarded(flaky("m", 4), "array<double>")("t").alias("g")).collect()}
    assert got[0]["value"] == E.hash_vector("fine", "m", 4) and got[0]["failure"] is None and len(got[3]["value"]) == 4
    assert got[1]["value"] is None and got[1]["failure"]["failure_type"] == "validation" and got[2]["failure"]["message"] == "no disk"


def test_the_channel_keeps_the_first_fault(spark):
    f = Faults()
    assert f.rows() is None
    rows = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    why = lambda m: F.struct(F.lit("a").alias("failure_type"), F.lit(None).cast("string").alias("error_code"), F.lit(m).alias("message")).alias("failure")
    f.report(rows.where("query_id < 3").select("query_id", why("first")))
    f.report(rows.where("query_id = 2").select("query_id", why("second")))
    assert sorted((r["query_id"], r["failure"]["message"]) for r in f.rows().collect()) == [(1, "first"), (2, "first")]
    assert [r["query_id"] for r in f.without(rows).collect()] == [3]


def left(spark):
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/loresift"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_requests_leave_no_tables(spark, engine):
    before = left(spark)
    with Runtime(lambda: engine).running() as runtime:
        runtime.search(SearchRequest("rank fusion", 2))
        runtime.compare(CompareRequest("rank fusion", ("bm25", "vector", "none"), 2))
        assert runtime.ask(AskRequest("What is rank fusion?"))["citations"]
        with pytest.raises(Exception, match="no disk"):
            runtime.search(SearchRequest("fault disk", 2, "vector"))
    assert left(spark) == before


def test_tables_count_what_they_write(spark):
    with Tables() as t:
        assert stored(spark.range(7), "seven").count() == 7 and stored(spark.range(0), "none").count() == 0
        assert stored(spark.range(5).where("id < 0"), "empty").count() == 0
        assert [(x["table"], x["rows"]) for x in t.written] == [("seven", 7), ("none", 0), ("empty", 0)] and all(x["ms"] > 0 for x in t.written)
        with Tables() as inner:
            stored(spark.range(1), "one")
        assert len(inner.written) == 1 and len(t.written) == 3
        before = left(spark)
    assert len(before - left(spark)) == 3


def test_settings_change_results(spark, engine):
    s, q = engine.settings, spark.createDataFrame([(1, "rank of tokens, of hits")], "query_id int, query string")

    def scores(**more):
        other = Engine(spark, Settings.of({"allowed": list(s.allowed), "retriever": "bm25", "index": {"path": s.index.path, "provider": "flaky"}, **more}))
        return {r["chunk_id"]: r["score"] for r in other.search(q, more.get("retriever")).collect()}

    plain = scores()
    assert scores(bm25={"k1": 0.3}) != plain != scores(bm25={"b": 0.0}) and scores(bm25={"k1": 1.5, "b": 0.75}) == plain
    assert scores(retriever="hybrid", hybrid={"vector_weight": 3.0}) != scores(retriever="hybrid") != scores(retriever="hybrid", hybrid={"constant": 1})
    R.TOKENIZERS.register("blanks", lambda c: F.split(F.lower(c), " "), replace=True)
    assert scores(tokenizer="blanks") != plain  # "tokens," is a token of its own there
    for bad in ({"tokenizer": "none"}, {"index": {"vector_store": "none"}}, {"hybrid": {"multiplier": 0}}, {"reports": {"preview": 0}}):
        with pytest.raises((ValueError, KeyError)):
            Settings.of(bad)
    assert issubclass(SettingsError, ValueError)


def test_page_settings_reach_the_parser(spark, monkeypatch):
    from loresift.operators import parse as P
    from loresift.operators.clean import PageCleaning

    raw = spark.createDataFrame([("d", "v", "h", "/d.pdf", "pdf", "d.pdf", 1, None, bytearray(b"x"))], "doc_id string, version_id string, content_hash string, source_path string, file_type string, filename string, file_size long, raw_text string, content binary")
    pages = spark.createDataFrame([("d", i, f"Head\nbody {i} text\nother {i} line\nmore {i}", None) for i in range(1, 5)], "doc_id string, page int, text string, error string")
    monkeypatch.setattr(P, "extract_pages", lambda _: pages)
    text = lambda c: P.parse(raw, c)[0].head()["text"]
    assert "Head" not in text(PageCleaning()) and "Head" in text(PageCleaning(min_length=5)) and "Head" not in text(PageCleaning(1))


def test_reports_equal_a_recount(spark, engine):
    at = engine.folder / "reports"
    built, read = (json.loads((at / f"{n}.json").read_text()) for n in ("build", "ingestion"))
    index = engine.index
    for name, said in (("documents", "document_count"), ("chunks", "chunk_count"), ("vectors", "vector_count")):
        assert built[said] == index.table(name).count() == 3
    assert built["embedding_cache_misses"] == 3 and built["empty_chunk_count"] == 0 and built["manifest"]["index_id"] == index.manifest.index_id
    assert [x["stage"] for x in built["manifest"]["stages"]] == ["failures", "documents", "blocks", "chunks", "vectors", "postings"]
    assert (read["candidate_count"], read["succeeded_count"], read["failed_count"]) == (3, 3, index.table("failures").count())
    q = spark.createDataFrame([(1, "rank fusion of the hits")], "query_id int, query string")
    stages = R.ResultStages(1, True, 3)
    body = engine.search_report(q, "bm25", stages)
    assert json.loads((at / "retrieval.json").read_text())["counts"] == body["counts"]
    found = R.RETRIEVERS["bm25"](engine._corpus(), q, 3)
    assert body["counts"] == {"candidate_count": found.count(), "deduplicated_count": found.count(), "returned_count": 1} and found.count() >= 2
    assert len(body["results"]) == 1 and len(body["results"][0]["text_preview"]) <= 12 and body["status"] == "success" and body["trace"]["stages"][0]["detail"]["written"][-1]["rows"] == 1
    assert body["runtime"]["config"]["bm25"] == {"k1": 1.5, "b": 0.75} and body["runtime"]["index"]["counts"]["chunks"] == 3
    bad = engine.search_report(q.withColumn("query", F.lit("fault disk")), "vector", name="bad.json")
    assert bad["status"] == "error" and bad["failure"]["failure_type"] == "infrastructure" and bad["results"] == [] and (at / "bad.json").exists()
    both = engine.compare_report(q, ["bm25", "vector", "none"], 2)
    by = {x["retriever"]: x for x in both["strategy_results"]}
    assert both["status"] == "partial_error" and by["none"]["error"] and by["bm25"]["returned_count"] == 2 and (at / "comparison.json").exists()
    with engine.ask(q) as a:
        stages = {x["stage"]: x["detail"]["written"][-1]["rows"] for x in a.trace.stages}
        assert stages["retrieval"] == a.hits.count() and stages["context_packing"] == a.packed.segments.count() and stages["generation"] == 1


def test_the_command_line_writes_the_run(spark, engine, capsys):
    d = engine.folder
    (d / "gold.jsonl").write_text('{"id": "a", "question": "rank fusion", "question_type": "fact", "expected_doc_ids": ["x"]}\n')
    (d / "s.toml").write_text(f'allowed = ["{d}"]\nretriever = "bm25"\n[index]\npath = "file://{d}/index"\nprovider = "flaky"\n[bm25]\nk1 = 0.7\n[reports]\npath = "file://{d}/cli"\n')
    assert cli.main(["--settings", str(d / "s.toml"), "evaluate", "--dataset", str(d / "gold.jsonl"), "--output", f"file://{d}/run"]) == 0
    said = json.loads(spark.read.text(f"file://{d}/run/run.json").head()[0])
    assert said["config"]["bm25"]["k1"] == 0.7 and said["index"]["index_id"] == engine.index.manifest.index_id and said["dataset"].endswith("gold.jsonl") and said["run_id"]
    rows = spark.read.json(f"file://{d}/run/case_results").collect()
    assert [(r["query_id"], r["status"]) for r in rows] == [("a", "success")]
    assert cli.main(["--settings", str(d / "s.toml"), "search", "rank fusion", "--top-k", "1"]) == 0
    assert (d / "cli" / "retrieval.json").exists() and "1." in capsys.readouterr().out


def test_fail_fast_and_failed_builds(spark, engine, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "raw" / "ok.txt").write_text("fine")
    base = {"allowed": [str(tmp_path)], "index": {"path": f"file://{tmp_path}/index"}, "reports": {"path": f"file://{tmp_path}/reports"}}
    with pytest.raises(ValueError, match="DOCUMENT_LOAD_FAILED.*bad.txt"):
        Engine(spark, Settings.of(base | {"scan": {"fail_fast": True}})).build(str(tmp_path / "raw"))
    said = json.loads((tmp_path / "reports" / "build.json").read_text())
    assert said["status"] == "failed" and "bad.txt" in said["error"]
    assert Engine(spark, Settings.of(base)).build(str(tmp_path / "raw")).counts["failures"] == 1


def test_model_faults_and_windows(spark, engine):
    """An endpoint that isn't there, and a prompt that is too long, fail one question each."""
    asked = spark.createDataFrame([(1, "rank fusion"), (2, "nothing")], "query_id int, query string")
    with engine.ask(asked) as a:
        for endpoint, said in ((G.Endpoint("http://127.0.0.1:9/x", retries=0, timeout=1.0), "GENERATION_FAILED"), (G.Endpoint(window=600), "more than the window")):
            rows = {r["query_id"]: r for r in G.answers(G.endpoint_payloads(asked, a.packed, endpoint), a.packed.citations).collect()}
            assert rows[1]["status"] == "failed" and said in rows[1]["fault"] and rows[2]["status"] == "abstained"
