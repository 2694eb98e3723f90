"""Command line (I9): index a folder or URL and ask, evaluate, or serve. `python -m stratagraph --help`."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from stratagraph.operators.generation import choose_provider
from stratagraph.plans import benchmark
from stratagraph.plans.engine import Engine
from stratagraph.service import Service
from stratagraph.sources.store import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratagraph", description=__doc__)
    p.add_argument("--store", default="stratagraph-store", help="folder of the stored tables")
    p.add_argument("--workspace", default="stratagraph-clones", help="folder of clones")
    todo = p.add_subparsers(dest="command", required=True)
    index = todo.add_parser("index", help="index a repository, once, and ask questions about it")
    index.add_argument("url")
    index.add_argument("--folder", help="a folder to read in place of a clone")
    index.add_argument("--ask", action="append", default=[], metavar="QUESTION")
    index.add_argument("--mode", choices=["hybrid", "vector"], default="hybrid")
    index.add_argument("--overview", action="store_true")
    evaluate = todo.add_parser("evaluate", help="run a benchmark and write its report")
    evaluate.add_argument("url")
    evaluate.add_argument("questions", help="JSON file: a list of question, category, relevant_files, entities")
    evaluate.add_argument("--folder")
    evaluate.add_argument("--name", default="evaluation")
    evaluate.add_argument("--retrieval-only", action="store_true")
    serve = todo.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--folders", help="a folder of this machine under which clients may have folders indexed; none by default")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("stratagraph").getOrCreate()
    engine = Engine(spark, Store(spark, os.path.abspath(a.store) if "://" not in a.store else a.store), answer=choose_provider())
    if a.command == "serve":
        Service(engine, a.workspace, folders=a.folders).server(port=a.port).serve_forever()
        return 0
    repository_id = benchmark.prepare(engine, a.url, a.folder, a.workspace)
    if a.command == "index":
        print(f"{repository_id} is ready")
        if a.overview:
            print(engine.overview(repository_id))
        if a.ask:
            for r in engine.ask(repository_id, a.ask, a.mode).orderBy("question_id").collect():
                print(f"\n{a.ask[r['question_id']]}\n{r['answer']}")
        return 0
    results = benchmark.run(engine, repository_id, benchmark.load_questions(spark, a.questions), generate=not a.retrieval_only)
    for path in benchmark.report(engine, repository_id, a.name, results):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
