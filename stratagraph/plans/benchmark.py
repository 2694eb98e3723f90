"""Whole evaluations: prepare a repository, run both systems, score, compare, report."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import evaluation as E
from stratagraph.operators import grounding as C
from stratagraph.operators import ranking as R
from stratagraph.plans.engine import Engine
from stratagraph.plans.scratch import materialize

SYSTEMS = ("vector", "hybrid")
RETRIEVAL = [*[f"recall_at_{k}" for k in E.KS], "precision_at_5", "mrr", "relevant_file_rate", "entity_coverage"]
ANSWERS = ["mention_coverage", "citation_accuracy", "citation_coverage"]
QUESTIONS = "question_id int, question string, category string, relevant_files array<string>, entities array<string>"


def prepare(engine: Engine, url: str, root: str | None = None, workspace: str | None = None) -> str:
    """The ready repository of that URL or name; indexed from a folder, or a clone in workspace, where there is none."""
    known = engine.store.repositories().where((F.col("status") == "ready") & ((F.col("url") == url) | (F.col("name") == url))).first()
    if known:
        return known["repository_id"]
    repository_id = engine.register(url)
    if root is None and workspace is None:
        raise ValueError("a folder or a workspace is needed to index the repository")
    engine.index(repository_id, root or engine.fetch(repository_id, workspace))
    return repository_id


def run(engine: Engine, repository_id: str, questions: DataFrame, systems: tuple[str, ...] = SYSTEMS, limit: int = R.CONTEXT_LIMIT, generate: bool = True) -> DataFrame:
    """A row a system and question: metrics, whether an answer cites what was not retrieved, files, and mean seconds of the batch.

    questions: QUESTIONS. A system's questions are one batch; its time is shared out evenly.
    """
    engine.store.require_ready(repository_id)
    questions = materialize(questions, "questions")
    n = max(1, questions.count())
    out = None
    for system in systems:
        began = time.time()
        ranked, facts = engine.retrieve(repository_id, questions, system, limit)
        retrieval_s = (time.time() - began) / n
        rows = ranked.select(F.lit(system).alias("system"), "question_id", "position", "file_path")
        scored = E.question_metrics(rows, questions)
        if scored.limit(1).count() == 0:  # nothing was retrieved for any question
            scored = E.question_metrics(questions.select(F.lit(system).alias("system"), "question_id", F.lit(1).alias("position"), F.lit("").alias("file_path")), questions)
        names = ranked.groupBy("question_id").agg(F.collect_set("entity_name").alias("__names"))
        files = R.cited_files(ranked).withColumnRenamed("files", "retrieved_files")
        some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
        row = scored.join(questions.select("question_id", "question", "relevant_files", "entities"), "question_id").join(names, "question_id", "left").join(files, "question_id", "left")
        row = row.withColumn("entity_coverage", E.entity_coverage(some("__names"), some("entities"))).withColumn("retrieval_s", F.lit(retrieval_s)).drop("__names")
        if generate:
            began = time.time()
            contexts = materialize(R.context_text(ranked, facts).join(questions.select("question_id", "question"), "question_id"), "contexts")
            answers = materialize(C.answers_for(contexts, ranked, engine.answer), "answered")
            cited = C.extract(answers).groupBy("question_id").agg(F.collect_list("file_path").alias("__cited"))
            answers = answers.join(cited, "question_id", "left").withColumn("generation_s", F.lit((time.time() - began) / n))
            row = row.join(answers, "question_id", "left").withColumn("mention_coverage", E.mention_coverage(F.coalesce("answer", F.lit("")), some("entities")))
            zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
            row = row.withColumn("citation_accuracy", E.citation_accuracy(zero(F.col("verified")), zero(F.col("unverified")))).withColumn("citation_coverage", E.citation_coverage(some("__cited"), F.col("relevant_files")))
            row = row.withColumn("hallucinated", zero(F.col("unverified")) > 0).drop("__cited", "verified", "unverified", "grounded", "abstained")
        row = materialize(row.drop("relevant_files", "entities"), f"evaluated_{system}")
        out = row if out is None else out.unionByName(row)
    return out


def report(engine: Engine, repository_id: str, name: str, results: DataFrame, folder: str = "reports") -> tuple[str, str]:
    """The evaluation as JSON and Markdown files in the store; their paths."""
    metrics = [m for m in [*RETRIEVAL, *ANSWERS] if m in results.columns]
    times = [c for c in ("retrieval_s", "generation_s") if c in results.columns]
    means = materialize(E.aggregate(results, [*metrics, *times]), "means")
    compared = E.compare(means, metrics)
    failures = E.failure_cases(results).select("system", "question", "category", "retrieved_files")
    counts = {t: engine.store.read(t, repository_id).count() for t in ("files", "entities", "chunks", "nodes", "edges")}
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row a system, category, metric or failure
    row = engine.store.get(repository_id)
    whole = {"benchmark": name, "repository": {"url": row["url"], **counts}, "configuration": engine.config(), "means": rows(means), "comparison": rows(compared), "failures": rows(failures), "questions": rows(results.drop("answer").orderBy("question_id", "system"))}
    head = f"Repository {row['url']}: " + ", ".join(f"{n} {t}" for t, n in counts.items())
    missed = "\n".join(f"- {r['system']}: {r['question']} ({r['category']}), found {', '.join(r['retrieved_files'] or []) or 'nothing'}" for r in whole["failures"])
    text = f"{head}\n\n{E.report(means, compared)}" + (f"\n## Failures\n\n{missed}\n" if missed else "")
    return engine.store.write_text(f"{folder}/{name}.json", json.dumps(whole, indent=1, default=str)), engine.store.write_text(f"{folder}/{name}.md", text)


def load_questions(spark, path: str) -> DataFrame:
    """Questions of a JSON file: a list of objects with question, category, relevant_files and entities."""
    df = spark.read.option("multiLine", True).schema("question string, category string, relevant_files array<string>, entities array<string>").json(path)
    rows = df.collect()  # a benchmark is a list that people wrote
    return spark.createDataFrame([(k, r["question"], r["category"], r["relevant_files"] or [], r["entities"] or []) for k, r in enumerate(rows)], QUESTIONS)
