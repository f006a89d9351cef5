"""Context, answers, evaluation, the engine end to end, and every query against SQL."""

import json
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from loresift import __main__ as cli
from loresift.engine import Engine
from loresift.operators import context as X
from loresift.operators import evaluate as V
from loresift.operators import generate as G
from loresift.settings import Settings, SettingsError
from loresift.streaming import ingest as S

SCHEMA = "query_id int, rank int, chunk_id string, doc_id string, version_id string, chunk_index int, text string, title string, section string, source_path string, page_start int, page_end int"


def evidence(spark, rows):
    return spark.createDataFrame([(1, r, c, d, "v", i, t, "T", s, f"/{d}", p, p) for r, (c, d, i, t, s, p) in enumerate(rows, 1)], SCHEMA)


def question(spark, text="q"):
    return spark.createDataFrame([(1, text)], "query_id int, query string")


def count(t):
    return len(re.findall(r"[a-zA-Z0-9_]+|[一-鿿]|[^\s]", t))


def fit(text, prefix, budget):
    """The longest prefix with an ellipsis that fits, as a search over all lengths."""
    if count(prefix + text) <= budget:
        return text
    best = None
    for n in range(len(text) + 1):
        cand = text[:n].rstrip() + "..."
        if count(prefix + cand) <= budget and cand != "...":
            best = cand
    return best


def greedy(texts, budget):
    out, used = [], 0
    for i, t in enumerate(texts, 1):
        prefix = f"[C{i}] "
        got = fit(t, prefix, budget - used) if budget - used > count(prefix) else None
        if got is None:
            break
        out.append(got)
        used += count(prefix + got)
        if got != t:
            break
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab .,中\n", min_size=1, max_size=30).filter(str.strip), min_size=1, max_size=6, unique_by=lambda t: " ".join(t.lower().split())), st.integers(1, 60))
def test_packing_equals_the_greedy_loop(spark, texts, room):
    rows = evidence(spark, [(f"c{i}", f"d{i}", 0, t, None, None) for i, t in enumerate(texts)])
    budget = X.Budget(room + 6, room, 1, 1, 1)
    got = X.assemble(rows, question(spark, "a b"), budget).segments.orderBy("pos").collect()
    assert [r["text"].rstrip() for r in got] == [t.rstrip() for t in greedy(texts, min(room, room + 6 - 3 - 2))]
    assert sum(r["token_count"] for r in got) <= room


def test_dedup_quota_merge_and_ranges(spark):
    rows = evidence(spark, [("a", "d", 0, "One two", "S", 1), ("b", "d", 1, "three", "S", 2), ("c", "e", 0, "one  TWO", None, None), ("x", "d", 2, "four", "U", 3), ("y", "f", 5, "five", None, None)])
    kept, dropped = X.select_evidence(X.passthrough(rows), 2)
    assert {(r["chunk_id"], r["reason"]) for r in dropped.collect()} == {("c", "duplicate_content"), ("x", "document_chunk_quota_exceeded")}
    packed = X.assemble(rows, question(spark), X.Budget(200, 60, 10, 20, 5))
    c = packed.citations.orderBy("pos").collect()
    assert [(r["citation_id"], r["chunk_id"], r["page_start"], r["page_end"], r["sections"]) for r in c] == [("C1", "a", 1, 2, ["S"]), ("C2", "y", None, None, [])]
    assert [(s["chunk_id"], s["char_start"], s["char_end"]) for s in c[0]["source_ranges"]] == [("a", 0, 7), ("b", 0, 5)]
    assert packed.segments.orderBy("pos").head()["text"] == "One two\nthree"
    kept, _ = X.select_evidence(X.passthrough(rows), 3)
    assert [len(r["sources"]) for r in X.merge_adjacent(kept).orderBy("pos").collect()] == [2, 1, 1]  # pairs only
    cut = X.assemble(rows, question(spark), X.Budget(40, 10, 1, 1, 1)).citations.head()
    assert [(s["chunk_id"], s["char_end"]) for s in cut["source_ranges"]] == [("a", 7), ("b", 5)]
    text = packed.texts(question(spark)).head()
    assert text["context_text"].startswith("[C1] One two\nthree\n\n[C2] five") and text["used_tokens"] == 10 and text["remaining_tokens"] == 50
    with pytest.raises(ValueError):
        X.Budget(100, 90, 10, 20, 5)


def test_transformers_are_checked(spark):
    rows = evidence(spark, [("a", "d", 0, "one", None, None), ("b", "e", 0, "two", None, None)])
    X.TRANSFORMERS.register("loses", lambda h: X.passthrough(h).where("rank = 1"), replace=True)
    out, degraded = X.transform_evidence(rows, "loses")
    assert degraded and out.count() == 2
    with pytest.raises(ValueError, match="EVIDENCE_TRANSFORM_FAILED"):
        X.transform_evidence(rows, "loses", fail_open=False)


def test_citation_checks(spark):
    allowed = spark.createDataFrame([(i, "C1", 0) for i in range(1, 9)], "query_id int, citation_id string, pos int")
    p = lambda **k: json.dumps({"answer": "x [C1]", "citation_ids": ["C1"], "abstained": False, "abstention_reason": None} | k)
    rows = [(1, p()), (2, p(citation_ids=["C9"], answer="x [C9]")), (3, p(answer="x")), (4, p(abstained=True)), (5, p(abstained=True, citation_ids=[], answer="none")), (6, "no json"), (7, p(abstained=True, citation_ids=[], answer="none", abstention_reason="r")), (8, p(citation_ids=[], answer="x")), (99, p())]
    df = spark.createDataFrame(rows, "query_id int, payload string")
    got = {r["query_id"]: r for r in G.answers(df, allowed).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "answered", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "failed", 7: "abstained", 8: "failed", 99: "abstained"}
    assert got[2]["fault"].startswith("CITATION_VALIDATION_FAILED") and got[99]["abstention_reason"]
    assert {r["status"] for r in G.answers(df.where("query_id = 2"), allowed, "abstain").collect()} == {"abstained"}


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "fact", ["d2"], False), (2, "none", [], True)], "query_id int, question_type string, expected_doc_ids array<string>, expected_abstention boolean")
    hits = spark.createDataFrame([(1, 1, "a", "d1"), (1, 2, "b", "d2")], "query_id int, rank int, chunk_id string, doc_id string")
    used = hits.withColumnRenamed("rank", "pos")
    cited = hits.where("rank = 2").withColumnRenamed("rank", "n")
    status = spark.createDataFrame([(1, "answered"), (2, "abstained")], "query_id int, status string")
    got = {r["query_id"]: r for r in V.case_metrics(cases, hits, used, cited, status).collect()}
    assert got[1]["retrieval_mrr"] == 0.5 and got[1]["retrieval_precision"] == 0.5 and got[1]["retrieval_recall"] == got[1]["citation_coverage"] == 1
    assert got[2]["retrieval_hit_rate"] is None and got[2]["abstention_accuracy"] == 1 and got[2]["answer_has_citation_ratio"] is None
    s = {(r["metric"], r["question_type"]): (r["mean"], r["n"]) for r in V.summary(V.case_metrics(cases, hits, used, cited, status)).collect()}
    assert s[("retrieval_mrr", None)] == (0.5, 1) and s[("abstention_accuracy", None)] == (1.0, 2)
    paths = spark.createDataFrame([(1, "fact", ["a\\b.md"], False)], "query_id int, question_type string, expected_source_paths array<string>, expected_abstention boolean")
    by_path = hits.withColumn("source_path", F.lit("a/b.md"))
    assert V.case_metrics(paths, by_path, by_path.withColumnRenamed("rank", "pos"), by_path.withColumnRenamed("rank", "n"), status).head()["retrieval_recall"] == 1


def test_engine_and_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("# Alpha\n\nReciprocal rank fusion merges lists.\n\n# Beta\n\nBudgets limit a context.")
    (raw / "b.txt").write_text("Unrelated words about cooking rice.")
    conf = tmp_path / "settings.toml"
    conf.write_text(f'allowed = ["{tmp_path}"]\nretriever = "bm25"\n[index]\npath = "file://{tmp_path}/index"\n[experiments.plain]\nretriever = "bm25"\ntop_k = 2\n[experiments.mixed]\nretriever = "hybrid"\ntop_k = 2\nreranking = true\n')
    assert cli.main(["--settings", str(conf), "index", "--source", str(raw)]) == 0
    assert cli.main(["--settings", str(conf), "search", "rank fusion", "--top-k", "1"]) == 0
    assert cli.main(["--settings", str(conf), "ask", "What does rank fusion merge?"]) == 0
    assert cli.main(["--settings", str(conf), "index", "--source", "/"]) == 1
    out = capsys.readouterr()
    assert "ready" in out.out and "Reciprocal" in out.out and "answered" in out.out and "INVALID_SOURCE" in out.err
    gold = tmp_path / "gold.jsonl"
    gold.write_text(json.dumps({"id": "g1", "question": "rank fusion", "question_type": "fact", "expected_source_paths": [str(raw / "a.md")]}) + "\n" + json.dumps({"id": "g2", "question": "zzzz", "question_type": "none", "expected_abstention": True}))
    assert cli.main(["--settings", str(conf), "evaluate", "--dataset", str(gold), "--output", f"file://{tmp_path}/run"]) == 0
    assert "retrieval_mrr" in capsys.readouterr().out and os.path.isdir(tmp_path / "run" / "case_results")
    engine = Engine(spark, Settings.load(conf))
    hits, both, errors, status = engine.compare(question(spark, "rank fusion"), ["bm25", "vector", "nope"], 2)
    assert status == "partial_error" and set(errors) == {"nope"} and hits.count() > 1 and both is not None
    with pytest.raises(Exception, match="INVALID_QUERY"):
        engine.search(question(spark, "  ")).collect()
    conf.write_text("[chunking]\nsize = 10\noverlap = 10\n")
    with pytest.raises(SettingsError, match="INVALID_CONFIG"):
        Settings.load(conf)
    assert Settings.load(tmp_path / "none.toml") == Settings()


def test_streaming_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    for n in range(2):
        spark.createDataFrame([(n * 10 + i, f"alpha beta{n} gamma{i}") for i in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    index = S.index_of(spark, f"{tmp_path}/out")
    assert index.stats.head()["n"] == 6 and {r["term"]: r["df"] for r in index.terms.collect()}["alpha"] == 6


def test_queries_equal_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)

    def rows(records, cols, names):
        at = [names.index(x) for x in cols]
        return sorted(tuple("NULL" if r[i] is None else f"{float(r[i]):.6f}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in at) for r in records)

    for name in sorted(n for n in sql if not n.startswith("op") and n != "pipeline"):
        df = queries[name](spark, d)
        cur = c.execute(sql[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns), name
        assert rows([tuple(r) for r in df.collect()], sorted(names), df.columns) == rows(cur.fetchall(), sorted(names), names), name
