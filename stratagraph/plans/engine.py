"""The engine: index a tree, ask questions, read the graph, summarise."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.functions import paths as P
from stratagraph.functions.vectors import dot, hashing_embedding, length
from stratagraph.operators import evaluation as E
from stratagraph.operators import facts as H
from stratagraph.operators import generation as L
from stratagraph.operators import graph as G
from stratagraph.operators import grounding as C
from stratagraph.operators import patterns as M
from stratagraph.operators import ranking as R
from stratagraph.operators import traverse as T
from stratagraph.plans import indexing as I
from stratagraph.plans.scratch import materialize
from stratagraph.sources import repository as S
from stratagraph.sources.store import NotFound, Store

TABLES = ("files", "entities", "chunks", "nodes", "edges")
NODES = "node_id string, node_type string, file_path string, class_name string, name string, language string, signature string, docstring string, start_line int, end_line int, repository_id string"
EDGES = "rel_type string, src string, dst string, module string, line int, repository_id string"
OVERVIEW_CHARS, SNIPPET = 12_000, 1_500
#: What an overview is made from: (text to search for, entity types, hits).
OVERVIEW_SEARCHES = [
    ("introduction and purpose of the project", ["doc_section"], 4),
    ("program start and configuration", ["module", "class", "function"], 5),
    ("central data types and storage", ["module", "class", "function"], 5),
    ("request handling and main work", ["module", "class", "function"], 5),
]
NETWORK_NODES, NETWORK_EDGES = 120, 400


@dataclass
class Engine:
    """embed: Column -> Column, the vector of a text (V1); answer: provider of answers."""

    spark: SparkSession
    store: Store
    embed: object = hashing_embedding
    answer: object = C.extractive_answers
    _graphs: dict = field(default_factory=dict, repr=False)

    def register(self, url: str) -> str:
        """A valid URL's repository; ValueError with the reason otherwise."""
        row = self.spark.createDataFrame([(url,)], "u string").select(P.url_normal(F.col("u")).alias("url"), P.url_reason(F.col("u")).alias("why"), P.repository_name(F.col("u")).alias("name")).first()
        if row["why"]:
            raise ValueError(f"repository URL refused: {row['why']}")
        return self.store.register(row["url"], row["name"])

    def fetch(self, repository_id: str, workspace: str) -> str:
        """S3: clone a registered repository; its folder."""
        from stratagraph.sources.git import clone

        row = self.store.get(repository_id)
        if row is None:
            raise NotFound(repository_id)
        self.store.set_status(repository_id, "cloning")
        try:
            return clone(row["url"], workspace, repository_id)
        except Exception as e:
            self.store.set_status(repository_id, "failed", str(e)[:500])
            raise

    def index(self, repository_id: str, root: str, full: bool = False) -> I.Indexed:
        """Scan, parse, resolve, chunk, embed and build the graph of a folder; states are logged, failures too. What was done is told.

        Where the folder was indexed before, only what has changed since is parsed, resolved, chunked and embedded anew (`plans.indexing`), with the
        same tables as a whole index gives; `full` asks for a whole one. The tables become visible together, at the end; a folder
        without sources gives empty ones. Until then, and after a failure, those of the index before stay.
        """
        state = lambda name, **known: self.store.set_status(repository_id, name, **known)
        try:
            done = I.index(self.spark, self.store, repository_id, root, self.embed, state, full)
            self._forget_graph(repository_id)
            self.store.set_status(repository_id, "ready")
        except Exception as e:
            self.store.set_status(repository_id, "failed", str(e)[:500])
            raise
        self.store.versions.vacuum(repository_id)
        return done

    def graph(self, repository_id: str) -> G.Graph:
        """The stored graph, cached until the repository is indexed or deleted. One whose files are missing or damaged is empty, and is tried again next time."""
        version = self.store.versions.manifest(repository_id)["version"]
        if repository_id in self._graphs and self._graphs[repository_id][0] != version:  # another process has indexed it
            self._forget_graph(repository_id)
        if repository_id not in self._graphs:
            held: list[DataFrame] = []
            try:
                for table, schema in (("nodes", NODES), ("edges", EDGES)):
                    held.append(self.store.read(table, repository_id, schema, version or None).persist())
                    held[-1].count()
            except Exception as e:
                for df in held:
                    df.unpersist()
                if not I.unreadable(e):
                    raise
                logging.getLogger(__name__).warning("no graph of %s: %s", repository_id, str(e)[:200])
                return G.Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
            self._graphs[repository_id] = version, G.Graph(*held)
        return self._graphs[repository_id][1]

    def _forget_graph(self, repository_id: str) -> None:
        if held := self._graphs.pop(repository_id, None):
            held[1].nodes.unpersist()
            held[1].edges.unpersist()

    def sql(self, query: str, repository_id: str) -> DataFrame:
        """Q17: SQL over the views nodes, edges, entities, chunks and files of one repository, as of one version.

        Each call has a session of its own for its views, so calls for several repositories do not meet.
        """
        self.store.require_ready(repository_id)
        session = self.spark.newSession()
        version = self.store.versions.manifest(repository_id)["version"]
        for t in TABLES:
            Store(session, self.store.root).read(t, repository_id, version=version).createOrReplaceTempView(t)
        return session.sql(query)

    def match(self, repository_id: str, pattern: list[tuple[str, str, str]]) -> DataFrame:
        """Q17: ways to bind the variables of (variable, relation, variable) triples to nodes of the graph."""
        return M.match(self._ready_graph(repository_id).edges, pattern)

    def ask(self, repository_id: str, questions: list[str], mode: str = "hybrid", limit: int = R.CONTEXT_LIMIT, generate: bool = True) -> DataFrame:
        """I4: answers (or, without generation, contexts) of a batch of questions in mode hybrid or vector, each with the retrievers that failed for it in `degraded`."""
        self.store.require_ready(repository_id)
        asked = self.spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
        found = self.retrieve_all(repository_id, asked, mode, limit)
        contexts = materialize(R.context_text(found.ranked, found.facts).join(asked, "question_id"), "contexts")
        out = C.answers_for(contexts, found.ranked, self.answer) if generate else contexts
        failed = found.degraded.groupBy("question_id").agg(F.array_sort(F.collect_set("retriever")).alias("degraded"))
        return out.join(F.broadcast(failed), "question_id", "left").withColumn("degraded", F.coalesce("degraded", F.array().cast("array<string>")))

    def retrieve(self, repository_id: str, asked: DataFrame, mode: str, limit: int = R.CONTEXT_LIMIT) -> tuple[DataFrame, DataFrame]:
        """(ranked items, facts) of asked(question_id, question) in mode hybrid or vector, written; raises where a retriever fails, so that no metric is of a part."""
        return self.retrieve_all(repository_id, asked, mode, limit, partial=False)[:2]

    def retrieve_all(self, repository_id: str, asked: DataFrame, mode: str, limit: int = R.CONTEXT_LIMIT, partial: bool = True) -> H.Retrieved:
        asked = asked.select("question_id", F.lit(repository_id).alias("repository_id"), "question")
        version = self.store.versions.manifest(repository_id)["version"]
        chunks = self.store.read("chunks", repository_id, version=version or None)
        none = asked.select("question_id", F.array().cast("array<string>").alias("facts"))
        if mode == "vector":
            return H.Retrieved(materialize(H.vector_only(asked, chunks, self.embed, limit), "ranked"), none, self.spark.createDataFrame([], "question_id long, retriever string, error string"))
        found = H.retrieve(asked, chunks, self.graph(repository_id), self.store.read("files", repository_id, version=version or None), self.embed, limit, partial)
        facts = none.select("question_id").join(found.facts, "question_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
        return H.Retrieved(materialize(found.ranked, "ranked"), materialize(facts, "facts"), materialize(found.degraded, "degraded"))

    def evaluate(self, repository_id: str, benchmark: DataFrame, limit: int = R.CONTEXT_LIMIT) -> DataFrame:
        """Retrieval metrics of both systems over questions(question_id, question, category, relevant_files); `plans.benchmark` runs the whole evaluation."""
        self.store.require_ready(repository_id)
        rows = lambda name: self.retrieve(repository_id, benchmark, name, limit)[0].select(F.lit(name).alias("system"), "question_id", "position", "file_path")
        return E.question_metrics(rows("hybrid").unionByName(rows("vector")), benchmark)

    # Reads of the graph (I5, I6), each a DataFrame ------------------------------------------------

    def _ready_graph(self, repository_id: str) -> G.Graph:
        self.store.require_ready(repository_id)
        return self.graph(repository_id)

    def _named(self, names: list[str], column: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], f"{column} string")

    def files(self, repository_id: str) -> DataFrame:
        return G.files_of(self._ready_graph(repository_id).nodes, repository_id)

    def file(self, repository_id: str, file_path: str) -> DataFrame:
        self.store.require_ready(repository_id)
        return S.read_file(self.store.read("files", repository_id), repository_id, file_path)

    def graph_overview(self, repository_id: str) -> DataFrame:
        nodes = self._ready_graph(repository_id).nodes
        pick = lambda *kinds: nodes.where(F.col("node_type").isin(*kinds)).select("file_path", "name")
        return G.overview(nodes.where("node_type = 'File'").select("file_path", "language"), pick("Class"), pick("Function"))

    def statistics(self, repository_id: str) -> DataFrame:
        g = self._ready_graph(repository_id)
        return G.statistics(g.nodes, g.edges)

    def network(self, repository_id: str, focus: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Q10 for the files, or Q11 around a node id."""
        g = self._ready_graph(repository_id)
        if focus:
            return T.ball_network(g.edges.where(F.col("rel_type").isin(H.CALLS)), self._named([focus], "id"), depth, NETWORK_EDGES)
        imports = g.edges.where("rel_type = 'FILE_IMPORTS_FILE'")
        defined = g.edges.where(F.col("rel_type").startswith("FILE_DEFINES")).select(F.col("src").alias("id"), F.col("dst").alias("definition"))
        return G.network(imports, defined, NETWORK_NODES)

    def file_contents(self, repository_id: str, file_path: str) -> DataFrame:
        return G.contents(self._ready_graph(repository_id).nodes, file_path)

    def class_info(self, repository_id: str, name: str) -> DataFrame:
        g = self._ready_graph(repository_id)
        return G.class_info(g.nodes, g.edges, name)

    def _calls(self, repository_id: str, name: str, here: str, there: str) -> DataFrame:
        g = self._ready_graph(repository_id)
        named = g.nodes.where(F.col("node_type").isin("Function", "Method") & (F.col("name") == name)).select(F.col("node_id").alias("target" if here == "dst" else "source"))
        calls = g.edges.where(F.col("rel_type").isin(H.CALLS))
        ids = (G.sources_of(calls, named) if here == "dst" else G.targets_of(calls, named)).select(F.col("id").alias("node_id")).distinct()
        return g.nodes.join(ids, "node_id", "left_semi").select("node_id", "node_type", "name", "class_name", "file_path", "start_line", "end_line").orderBy("file_path", "start_line", "node_id")

    def callers(self, repository_id: str, name: str) -> DataFrame:
        return self._calls(repository_id, name, "dst", "src")

    def callees(self, repository_id: str, name: str) -> DataFrame:
        return self._calls(repository_id, name, "src", "dst")

    def _imports(self, repository_id: str, file_path: str, here: str, there: str) -> DataFrame:
        edges = self._ready_graph(repository_id).edges.where((F.col("rel_type") == "FILE_IMPORTS_FILE") & (F.col(here) == f"File:{file_path}"))
        return edges.select(F.regexp_replace(there, "^File:", "").alias("file_path"), "module", "line").orderBy("file_path")

    def importers(self, repository_id: str, file_path: str) -> DataFrame:
        return self._imports(repository_id, file_path, "dst", "src")

    def imports(self, repository_id: str, file_path: str) -> DataFrame:
        return self._imports(repository_id, file_path, "src", "dst")

    def path(self, repository_id: str, source: str, target: str) -> DataFrame:
        """Q14 between files."""
        edges = self._ready_graph(repository_id).edges.where("rel_type = 'FILE_IMPORTS_FILE'")
        pair = self.spark.createDataFrame([(f"File:{source}", f"File:{target}")], "source string, target string")
        return T.shortest_chains(edges, pair).select("length", F.transform("path", lambda p: F.regexp_replace(p, "^File:", "")).alias("path"))

    # Summaries ------------------------------------------------------------------------------------

    def summary(self, repository_id: str) -> str:
        """Largest directories, most imported files, files that start things, and counts, a line each."""
        g = self._ready_graph(repository_id)
        imports = g.edges.where("rel_type = 'FILE_IMPORTS_FILE'")
        plain = lambda c: F.regexp_replace(c, "^File:", "").alias("f")
        parts = [
            ("Directories", [f"{r['directory']} ({r['n']} files)" for r in directory_summary(G.files_of(g.nodes)).collect()]),
            ("Imported most", [f"{r['f']} ({r['in_degree']} importers)" for r in G.central(imports, 8).select(plain("id"), "in_degree").collect()]),
            ("Import others and are never imported", [r["f"] for r in G.entry_points(imports, 6).select(plain("id")).collect()]),
            ("Nodes", [f"{r['n']} {r['type']}" for r in G.statistics(g.nodes, g.edges).where("kind = 'node' and type is not null").orderBy("type").collect()]),
        ]
        return "\n".join(f"- {head}: {', '.join(items)}" for head, items in parts if items) or "- Nothing is known of the structure."

    def overview_context(self, repository_id: str) -> str:
        """Extracts that a few searches find, documentation first, up to the first one that overflows."""
        self.store.require_ready(repository_id)
        chunks = self.store.read("chunks", repository_id)
        asked = self.spark.createDataFrame([(k, q, kinds, n) for k, (q, kinds, n) in enumerate(OVERVIEW_SEARCHES)], "query_id int, q string, kinds array<string>, n int")
        asked = asked.withColumn("qv", self.embed(F.col("q")))
        scored = chunks.join(F.broadcast(asked), F.array_contains("kinds", F.col("entity_type"))).withColumn("score", F.round(dot(F.col("qv"), F.col("embedding")) / (length(F.col("qv")) * length(F.col("embedding"))), 6))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file_path", "start_line", "entity_name"))
        hits = scored.withColumn("rank", place).where(F.col("rank") <= F.col("n")).withColumn("seq", F.col("query_id") * 100 + F.col("rank"))
        return "\n\n".join(r["block"] for r in overview_prefix(hits).orderBy("seq").collect()) or "Nothing was found."

    def overview(self, repository_id: str, connector: L.Connector | None = None) -> str:
        """An introduction by the language model, or a digest of what is known where none answers."""
        row = self.store.require_ready(repository_id)
        files = self.store.read("files", repository_id)
        languages = ", ".join(f"{r['language']} ({r['n']})" for r in S.language_counts(files).collect()) or "unknown"
        frameworks = ", ".join(r["framework"] for r in S.frameworks(files).orderBy("framework").collect()) or "none"
        given = {"name": row["name"] or row["url"], "files": files.count(), "languages": languages, "frameworks": frameworks, "structure": self.summary(repository_id)}
        connector = connector or L.configured()
        if connector:
            try:
                return connector.ask(L.OVERVIEW_PROMPT.format(**given, context=self.overview_context(repository_id)), L.OVERVIEW_RULES)
            except (OSError, ValueError):
                pass
        return "# {name}\n\nNo language model answers; this is what the index holds.\n\n- Files: {files}\n- Languages: {languages}\n- Frameworks: {frameworks}\n\n## Structure\n{structure}\n".format(**given)

    def health(self) -> dict:
        """What works."""
        connector = L.configured()
        return {"storage": self.store.ping(), "language_model": bool(connector and connector.available()), "spark": self.spark.version}

    def config(self) -> dict:
        connector = L.configured()
        return {"root": self.store.root, "context_limit": R.CONTEXT_LIMIT, "context_chars": R.CONTEXT_CHARS, "per_file": R.PER_FILE_CAP, "language_model": connector.model if connector else None}

    def delete(self, repository_id: str) -> None:
        self._forget_graph(repository_id)
        self.store.remove(repository_id)


def directory_summary(files: DataFrame, k: int = 12) -> DataFrame:
    """(directory, n) of the k directories with most files, ties by name."""
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("(root)")
    return files.groupBy(folder.alias("directory")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "directory").limit(k)


def overview_prefix(hits: DataFrame, budget: int = OVERVIEW_CHARS) -> DataFrame:
    """hits(repository_id, seq, file_path, entity_type, entity_name, start_line, end_line, content) -> (repository_id, seq, block), distinct by file and start, up to the first block that overflows."""
    one = hits.groupBy("repository_id", "file_path", "start_line").agg(F.min_by(F.struct("seq", "entity_type", "entity_name", "end_line", "content"), "seq").alias("h"))
    head = F.format_string("### %s %s (%s:%d-%d)\n", "h.entity_type", "h.entity_name", "file_path", "start_line", "h.end_line")
    blocks = one.select("repository_id", "h.seq", F.concat(head, F.substring("h.content", 1, SNIPPET)).alias("block"))
    upto = F.sum(F.length("block")).over(Window.partitionBy("repository_id").orderBy("seq"))
    return blocks.withColumn("upto", upto).where(F.col("upto") <= budget).drop("upto")
