"""Command line: index, search, ask, evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .operators import evaluate as V
from .operators import reports
from .operators.retrieve import ResultStages
from .settings import Settings
from .sources import gold
from .sources.session import Tables, stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loresift", description=__doc__)
    p.add_argument("--settings", help="a TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index", help="build the index of a directory").add_argument("--source", required=True)
    s = sub.add_parser("search", help="search the index")
    s.add_argument("query")
    s.add_argument("--top-k", type=int)
    s.add_argument("--retriever")
    sub.add_parser("ask", help="answer a question").add_argument("question")
    e = sub.add_parser("evaluate", help="run the experiments on a gold set")
    e.add_argument("--dataset", required=True)
    e.add_argument("--output", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("loresift").getOrCreate()
    engine = Engine(spark, Settings.load(a.settings))
    one = lambda text: spark.createDataFrame([(1, text)], "query_id int, query string")
    try:
        if a.command == "index":
            m = engine.build(a.source)
            print(f"{m.index_id} {m.status}: " + ", ".join(f"{v} {k}" for k, v in m.counts.items()))
        elif a.command == "search":
            stages = ResultStages(a.top_k or engine.settings.results.top_k, engine.settings.results.reranking)
            with Tables():
                for r in engine.search(one(a.query), a.retriever, stages).orderBy("rank").collect():
                    print(f"{r['rank']}. {r['score']} {r['source_path']} [{r['chunk_id']}]\n   {r['text'][:160]}")
            if engine.settings.reports.path:
                engine.search_report(one(a.query), a.retriever, stages)
        elif a.command == "ask":
            with engine.ask(one(a.question)) as answered:
                r = answered.answers.head()
            print(f"{r['status']}: {r['answer'] or r['abstention_reason']}")
        else:
            run = engine.run_info(a.dataset)
            with Tables():
                metrics = stored(engine.evaluate(gold.load(spark, a.dataset)), "evaluation")
                print(reports.write_evaluation(metrics, V.summary(metrics), a.output, run))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
