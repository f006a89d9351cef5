"""Queries over BM25 hold no pairs of question and chunk outside the batch that scores them."""

import pytest

import __spark_entry__ as entry
from loresift.operators import retrieve as R

NAMES = [
    "eval_case_metrics",
    "lexical_rerank",
    "evidence_selection",
    "pack_context",
    "hybrid_vector_bm25",
    "experiment_suite",
    "evidence_checks",
    "mock_answers",
    "hybrid_rrf",
    "eval_summary",
    "dropped_evidence",
    "compare_overlap",
    "citation_rows",
    "bm25_batch",
    "rerank_stage",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_are_grouped(spark, monkeypatch, name):
    """Neither sums over pairs nor postings grouped by chunk, which make a task's memory grow with the chunks."""

    def grouped(*_, **__):
        raise AssertionError("pairs or postings are grouped in a shuffle")

    monkeypatch.setattr(R, "bm25_scores", grouped)
    monkeypatch.setattr(R, "_chunk_rows", grouped, raising=False)
    assert len(entry.queries()[name](spark, "/root/testdata/sf0.001").columns) > 1
