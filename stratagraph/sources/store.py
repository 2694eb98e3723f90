"""Stored tables by repository, upserts, deletes, and the catalog of repositories.

Tables live in versions (`sources.versions`): a repository's tables are replaced all at once, also by empty ones, and a writer
that fails at any step leaves the version before it as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.sources.versions import Files, NoTable, Versions

# The states of a repository, in order.
STATES = ["queued", "cloning", "parsing", "creating_embeddings", "building_graph", "indexing", "ready", "failed"]
#: Lookup keys of stored tables: rows of a file are sorted by them, so that Parquet's statistics skip what a lookup does not need.
LAYOUT = {
    "files": ["file_path"], "entities": ["file_path", "start_line"], "chunks": ["entity_type", "file_path"], "nodes": ["node_type", "name", "node_id"], "edges": ["rel_type", "dst", "src"],
    # References are sorted by the names that a change is looked up by.
    "imports": ["source_file"], "calls": ["callee_name"], "inherits": ["parent_class"],
}
#: Where the catalog's log is, and the parts above which it is rewritten as one.
CATALOG_SCOPE, LOG_PARTS = "catalog", 16
CATALOG = "repository_id string, name string, url string, status string, error string, language_counts string, updated double, created double, deleted boolean"


class NotFound(KeyError):
    """The repository is unknown."""


class NotReady(RuntimeError):
    """The repository is not indexed yet."""


class Staged:
    """Tables of a repository that are written but not visible; `commit` shows them all at once."""

    def __init__(self, store: Store, repository_id: str):
        self.store, self.repository_id, self.entries = store, repository_id, {}

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table; what was written, read again."""
        v = self.store.versions
        self.entries[table] = v.put(self.repository_id, table, df)
        return v.rows(self.entries[table])

    def amend(self, table: str, old: dict, gone: DataFrame, df: DataFrame) -> DataFrame:
        """The stored entry `old` without the rows that gone(key columns) names, and with those of df; the rows of the result. What is written grows with df and gone."""
        v = self.store.versions
        self.entries[table] = v.amended(self.repository_id, table, old, gone, v.put(self.repository_id, table, df))
        return v.rows(self.entries[table])

    def keep(self, table: str, old: dict) -> DataFrame:
        """The stored entry as it is; its rows."""
        self.entries[table] = old
        return self.store.versions.rows(old)

    def commit(self) -> int:
        return self.store.versions.commit(self.repository_id, lambda old: old | self.entries)


class Store:
    """Versioned tables of each repository under a folder; the catalog is a log of states, compacted by the count of its parts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root, LAYOUT)

    def stage(self, repository_id: str) -> Staged:
        return Staged(self, repository_id)

    def replace(self, repository_id: str, tables: dict[str, DataFrame]) -> int:
        """Put these tables in the place of the repository's stored ones, all at once, empty ones too; the new version."""
        return self.versions.replace(repository_id, tables)

    def read(self, table: str, repository_id: str | None = None, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A repository's table as of its last version, or of the one asked for; without a repository, that of all, a branch for each.

        An absent table is empty if its schema is given; NoTable tells otherwise.
        """
        if repository_id is not None:
            return self.versions.read(repository_id, table, schema, version)
        found = []
        for scope in self.versions.scopes():
            try:
                found.append(self.versions.read(scope, table))
            except NoTable:
                continue
        if not found:
            if schema is None:
                raise NoTable(table)
            return self.spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def ensure(self, repository_id: str, table: str, schema: str) -> None:
        """An empty table of that schema where there is none."""
        empty = self.spark.createDataFrame([], schema)

        def change(tables: dict) -> dict:
            return tables if table in tables else tables | {table: self.versions.put(repository_id, table, empty)}

        self.versions.commit(repository_id, change)

    def ping(self) -> bool:
        """Q20: the root can be reached and made."""
        try:
            fs, path = self.versions.files.path()
            return bool(fs.exists(path) or fs.mkdirs(path))
        except Exception:  # whatever the file system raises, it cannot be reached
            return False

    def write_text(self, name: str, text: str) -> str:
        """One file under the root, replaced by one rename; its path."""
        files: Files = self.versions.files
        aside = f"{name}.{uuid.uuid4().hex}.part"
        files.write(aside, text)
        try:
            files.rename(aside, name, replace=True)
        except BaseException:
            files.delete(aside)
            raise
        return files.path(name)[1].toString()

    def upsert(self, df: DataFrame, table: str, key: str = "id") -> None:
        """Rows of df replace stored rows of the same key in the same repository; the rest stay. What is written grows with df, not with the table.

        A batch belongs to few repositories: each gets a version of its own.
        """
        for repository_id in [r[0] for r in df.select("repository_id").distinct().collect()]:
            self.versions.upsert(repository_id, table, df.where(F.col("repository_id") == repository_id), key)

    def delete(self, table: str, repository_id: str) -> None:
        """A repository's table goes; nothing to drop is no error."""
        self.versions.commit(repository_id, lambda tables: {k: v for k, v in tables.items() if k != table})

    # Catalog -----------------------------------------------------------------

    def _log(self, **row) -> None:
        values = {"updated": time.time(), "deleted": False} | row
        names = [c.split()[0] for c in CATALOG.split(", ")]
        self.versions.append(CATALOG_SCOPE, "states", self.spark.createDataFrame([tuple(values.get(n) for n in names)], CATALOG).coalesce(1))
        if self.versions.parts(CATALOG_SCOPE, "states") > LOG_PARTS:
            self.versions.compact(CATALOG_SCOPE, "states", lambda log: self._last(log).select(*names))
            self.versions.vacuum(CATALOG_SCOPE)

    def register(self, url: str, name: str) -> str:
        """A new repository, queued."""
        repository_id = uuid.uuid4().hex[:12]
        self._log(repository_id=repository_id, name=name, url=url, status="queued", created=time.time())
        return repository_id

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        """The last state of each repository, which the log can be replaced by."""
        return log.groupBy("repository_id").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated"))).alias(c) for c in ("name", "url", "language_counts")], F.max_by("status", "updated").alias("status"), F.max_by("error", "updated").alias("error"),
            F.min("created").alias("created"), F.max("updated").alias("updated"), F.max("deleted").alias("deleted"),
        )

    def repositories(self) -> DataFrame:
        """The last state of each repository, newest first."""
        last = self._last(self.versions.read(CATALOG_SCOPE, "states", CATALOG))
        return last.where("not deleted").drop("deleted").orderBy(F.desc("created"), "repository_id")

    def get(self, repository_id: str) -> dict | None:
        row = self.repositories().where(F.col("repository_id") == repository_id).first()
        return row.asDict() if row else None

    def set_status(self, repository_id: str, status: str, error: str | None = None, language_counts: dict | None = None) -> None:
        if status not in STATES:
            raise ValueError(status)
        self._log(repository_id=repository_id, status=status, error=error, language_counts=json.dumps(language_counts) if language_counts is not None else None)

    def remove(self, repository_id: str) -> None:
        """The catalog forgets the repository first, so that nobody is led to rows that are going."""
        self._log(repository_id=repository_id, deleted=True)
        self.versions.drop(repository_id)

    def require_ready(self, repository_id: str) -> dict:
        """I8."""
        row = self.get(repository_id)
        if row is None:
            raise NotFound(repository_id)
        if row["status"] != "ready":
            raise NotReady(f"{repository_id} is {row['status']}")
        return row
