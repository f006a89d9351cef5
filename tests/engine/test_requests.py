"""Requests to a model: each answered once, whatever dies on the way."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loresift.operators import generate as G
from loresift.operators.context import Packed
from loresift.operators.requests import Log, Pace, logged


def prompts(spark, n, of=None):
    return spark.range(n).select(F.col("id").alias("query_id"), F.lit("s").alias("system_prompt"), F.concat(F.lit("p"), (F.col("id") % (of or n)).cast("string")).alias("user_prompt"))


def calls(at):
    return sorted(x for name in os.listdir(at) for x in open(f"{at}/{name}").read().split())


def recording(at, dies=None, fails=()):
    """Answers, and writes down what it was asked; `dies` ends the worker after so many calls, once."""
    os.makedirs(at, exist_ok=True)
    count = [0]

    def ask(system, user):
        with open(f"{at}/{os.getpid()}", "a") as f:
            f.write(user + "\n")
        count[0] += 1
        if dies and count[0] >= dies and not os.path.exists(f"{at}-died"):
            open(f"{at}-died", "w").close()
            os._exit(1)
        return (None, "GENERATION_FAILED: busy") if user in fails else (f"answer to {user}", None)

    return ask


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = logged(prompts(spark, 40, 10), recording(at), log, buckets=3).collect()
    assert len(rows) == 40 and all(r["payload"] == f"answer to p{r['query_id'] % 10}" and r["error"] is None for r in rows)
    assert calls(at) == sorted(f"p{i}" for i in range(10))
    again = logged(prompts(spark, 12), recording(at), log, buckets=3).collect()
    assert len(again) == 12 and calls(at) == sorted([f"p{i}" for i in range(12)])  # two are new
    assert logged(prompts(spark, 5), recording(at), log, buckets=3, model="other").count() == 5 and len(calls(at)) == 17


def test_a_task_that_dies_repeats_only_open_requests(spark, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "calls")
    with pytest.raises(Exception):  # noqa: B017, PT011 (however Spark says that a worker died)
        logged(prompts(spark, 30), recording(at, dies=12), log, buckets=1, in_flight=1).collect()
    before = calls(at)
    assert 12 == len(before) == len(set(before))
    with open(f"{log}/00000/cut.jsonl", "w") as f:
        f.write('{"key": "abc", "payl')  # a writer that died within a line
    rows = logged(prompts(spark, 30), recording(at, dies=12), log, buckets=1, in_flight=1).collect()
    assert sorted(r["payload"] for r in rows) == sorted(f"answer to p{i}" for i in range(30))
    after = calls(at)
    assert len(after) == 31 and [x for x in set(after) if after.count(x) > 1] == [x for x in before if after.count(x) > 1]  # only the one that died


def test_errors_are_asked_again(spark, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = {r["query_id"]: r for r in logged(prompts(spark, 4), recording(at, fails=("p2",)), log, buckets=2).collect()}
    assert rows[2]["payload"] is None and "busy" in rows[2]["error"] and rows[1]["payload"] == "answer to p1"
    rows = {r["query_id"]: r for r in logged(prompts(spark, 4), recording(at), log, buckets=2).collect()}
    assert rows[2]["payload"] == "answer to p2" and calls(at) == ["p0", "p1", "p2", "p2", "p3"]
    assert logged(prompts(spark, 0), recording(at), log).collect() == []


def test_calls_in_flight_and_pace(spark, tmp_path):
    folder = str(tmp_path)
    log = Log(folder, 7)
    log.add("k", "v")
    log.close()
    assert Log(folder, 7).answers() == {"k": "v"} and Log(folder, 8).answers() == {}
    pace, began = Pace(50.0), time.monotonic()
    for _ in range(6):
        pace.wait()
    assert time.monotonic() - began >= 0.09

    def counting():
        now = [0]

        def ask(system, user):
            now[0] += 1
            seen = now[0]
            time.sleep(0.02)
            now[0] -= 1
            return str(seen), None

        return ask

    most = {n: max(int(r["payload"]) for r in logged(prompts(spark, 24), counting(), f"{folder}/{n}", buckets=1, in_flight=n).collect()) for n in (1, 3)}
    assert most[1] == 1 and 2 <= most[3] <= 3


class Endpoint(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):  # noqa: N802 (the server's name)
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        user = body["messages"][1]["content"]
        self.seen.append(user)
        if "fails" in user:
            self.send_error(500)
            return
        content = json.dumps({"answer": "so [C1].", "citation_ids": ["C1"], "abstained": False, "abstention_reason": None})
        out = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


def test_endpoint_with_a_log(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        asked = spark.createDataFrame([(1, "a question"), (2, "one that fails"), (3, "without evidence")], "query_id int, query string")
        rows = [(q, "C1", 0, "c", "d", "v", "t", "/p", "snip", None, None, "s", ["s"], [("c", 0, 3)]) for q in (1, 2)]
        cited = spark.createDataFrame(rows, "query_id int, citation_id string, pos int, chunk_id string, doc_id string, version_id string, title string, source_path string, snippet string, page_start int, page_end int, section string, sections array<string>, source_ranges array<struct<chunk_id:string,char_start:int,char_end:int>>")
        segments = spark.createDataFrame([(q, 0, "C1", "text", 4, 4, 9) for q in (1, 2)], "query_id int, pos int, citation_id string, text string, token_count int, used_tokens int, available_tokens int")
        packed = Packed(segments, cited, None)
        where = G.Endpoint(f"http://127.0.0.1:{server.server_port}/", retries=0, timeout=5.0, log=str(tmp_path / "log"))
        for _ in range(2):
            got = {r["query_id"]: r for r in G.answers(G.endpoint_payloads(asked, packed, where), cited).collect()}
            assert (got[1]["status"], got[1]["citation_ids"], got[3]["status"]) == ("answered", ["C1"], "abstained")
            assert got[2]["status"] == "failed" and got[2]["fault"] == "GENERATION_FAILED: HTTP 500"
        assert sum("a question" in x for x in Endpoint.seen) == 1 and sum("fails" in x for x in Endpoint.seen) >= 2
    finally:
        server.shutdown()
