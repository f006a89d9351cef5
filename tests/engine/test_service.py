import pytest

from loresift.engine import Engine
from loresift.service import ROUTES, AskRequest, CompareRequest, RequestError, Runtime, SearchRequest
from loresift.settings import Settings


@pytest.mark.parametrize("kind,data", [(SearchRequest, {"query": " "}), (SearchRequest, {"query": "q", "top_k": 51}), (SearchRequest, {"query": "q", "top_k": True}), (SearchRequest, {"query": "q", "more": 1}), (SearchRequest, {}), (CompareRequest, {"query": "q", "retrievers": []}), (CompareRequest, {"query": "q", "retrievers": ["a", " a "]}), (AskRequest, {"question": 3})])
def test_requests_are_checked(kind, data):
    with pytest.raises(RequestError, match="INVALID_REQUEST"):
        kind.of(data)


def test_life_and_requests(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.md").write_text("# Alpha\n\nReciprocal rank fusion merges lists.")
    settings = Settings.of({"allowed": [str(tmp_path)], "retriever": "bm25", "index": {"path": f"file://{tmp_path}/index"}})
    runtime = Runtime(lambda: Engine(spark, settings))
    with pytest.raises(ValueError, match="INDEX_NOT_FOUND"):
        runtime.start()
    assert runtime.state == "failed"
    Engine(spark, settings).build(str(tmp_path / "raw"))
    with runtime.running():
        assert runtime.health()["counts"]["documents"] == 1
        got = runtime.search(SearchRequest.of({"query": "rank fusion", "top_k": 2}))
        assert got["results"][0]["rank"] == 1 and "fusion" in got["results"][0]["text"]
        both = runtime.compare(CompareRequest.of({"query": "rank", "retrievers": ["bm25", "none"]}))
        assert both["status"] == "partial_error" and len(both["results"]["bm25"]) == 1 and "none" in both["errors"]
        answer = runtime.ask(AskRequest.of({"question": "What is rank fusion?"}))
        assert answer["status"] == "answered" and answer["citations"][0]["citation_id"] == "C1" and len(answer["trace"]) == 4
        assert [r["chunk_count"] for r in runtime.documents().collect()] == [1]
        with pytest.raises(RequestError):
            runtime.search(SearchRequest("q", retriever="none"))
    assert runtime.state == "stopped" and {r.handler for r in ROUTES} <= set(dir(runtime))
    with pytest.raises(RuntimeError):
        _ = runtime.engine
