"""Versioned tables: snapshots by manifest, merge-on-read upserts, compaction, clean-up.

A scope (a repository, or the catalog) has numbered versions. A version is one small JSON file that names, for each table, the
folders of its rows, the folders of its deletion bitmaps, and its schema. Rows are written to new folders first; then the manifest is
written under a name of its own and renamed to the next number, which fails if another writer has taken that number. That
rename is all there is to a commit: whatever a writer that ends before it has left behind is never read, and readers see
all tables of a scope as of one version.

An upsert of k rows writes those rows, and a bitmap for each stretch of 32,768 stored rows that holds one it replaces; stored
rows are not rewritten. Reading leaves out the rows whose bit is set, by a broadcast of the bitmaps. Both are bounded: a
table of over PARTS folders, or over BUCKETS bitmaps (16 MB), is rewritten whole by the upsert that would pass the bound.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.functions import bitmaps as B

#: Folders of a table, and buckets of deletion bitmaps, above which an upsert rewrites it.
PARTS, BUCKETS = 8, 4096
#: Times a commit is tried when other writers are faster; versions that stay; seconds that a folder without a version may be someone's work.
TRIES, KEEP, GRACE = 8, 3, 86_400.0


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class NoTable(KeyError):
    """The scope has no table of that name."""


class Files:
    """Small files of a Hadoop file system under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def names(self, folder: str) -> list[tuple[str, float]]:
        """(name, time of last change) of what a folder holds; none if it is not there."""
        fs, path = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path)] if fs.exists(path) else []

    def text(self, name: str) -> str:
        fs, path = self.path(name)
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        fs, path = self.path(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def rename(self, old: str, new: str, replace: bool) -> None:
        """One step of the file system; Conflict where `new` is there and must not be replaced. Any other failure raises too."""
        context = self.spark.sparkContext
        jvm, (_, source), (_, target) = context._jvm, self.path(old), self.path(new)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = context._gateway.new_array(kind, int(replace))
        if replace:
            options[0] = kind.OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(new) from None
            raise

    def delete(self, name: str) -> None:
        fs, path = self.path(name)
        fs.delete(path, True)


class Versions:
    """Tables of many scopes under a root. `layout` names the columns that a table's files are sorted by."""

    def __init__(self, spark: SparkSession, root: str, layout: dict[str, list[str]] | None = None):
        self.spark, self.files, self.layout = spark, Files(spark, root), layout or {}

    # Versions ----------------------------------------------------------------

    def scopes(self) -> list[str]:
        return sorted(n for n, _ in self.files.names("versions"))

    def numbers(self, scope: str) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self.files.names(f"versions/{scope}") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, scope: str, version: int | None = None) -> dict:
        """A version, by default the last one; version 0 has no table."""
        numbers = self.numbers(scope)
        if version is None and not numbers:
            return {"version": 0, "tables": {}}
        if version is not None and version not in numbers:
            raise NoTable(f"{scope} has no version {version}")
        return json.loads(self.files.text(f"versions/{scope}/{numbers[-1] if version is None else version:012d}.json"))

    def commit(self, scope: str, change: Callable[[dict], dict]) -> int:
        """Make the next version: `change` gets the last version's tables and returns the new ones. Tried again when another writer was faster."""
        for _ in range(TRIES):
            last = self.manifest(scope)
            try:
                return self._publish(scope, last["version"] + 1, change(dict(last["tables"])))
            except Conflict:
                continue
        raise Conflict(f"{scope}: other writers were faster {TRIES} times")

    def _publish(self, scope: str, version: int, tables: dict) -> int:
        aside = f"versions/{scope}/.{uuid.uuid4().hex}.part"
        self.files.write(aside, json.dumps({"version": version, "tables": tables, "time": time.time()}))
        try:
            self.files.rename(aside, f"versions/{scope}/{version:012d}.json", replace=False)
        except BaseException:
            self.files.delete(aside)
            raise
        return version

    # Rows --------------------------------------------------------------------

    def put(self, scope: str, table: str, df: DataFrame) -> dict:
        """Write rows to a folder of their own; the table's entry for a manifest."""
        keys = [c for c in self.layout.get(table, []) if c in df.columns]
        folder = f"data/{scope}/{table}/{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(f"{self.files.root}/{folder}")
        return {"data": [folder], "deletes": [], "buckets": 0, "schema": df.schema.jsonValue()}

    def rows(self, entry: dict, places: bool = False) -> DataFrame:
        """Rows of an entry that no bitmap deletes; with `places`, also __file and __row, where each is stored."""
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["data"]:
            return self.spark.createDataFrame([], schema).select("*", *([F.lit("").alias("__file"), F.lit(0).cast("long").alias("__row")] if places else []))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{f}" for f in entry["data"]])
        columns = rows.columns
        if entry["deletes"] or places:
            rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        if entry["deletes"]:
            dead = self.spark.read.parquet(*[f"{self.files.root}/{f}" for f in entry["deletes"]])
            dead = dead.groupBy("__file", "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))
            marked = rows.withColumn("__bucket", B.bucket(F.col("__row"))).join(F.broadcast(dead), ["__file", "__bucket"], "left")
            rows = marked.where(~B.has_bit(F.col("__bits"), B.place(F.col("__row"))))
        return rows.select(*columns, *(["__file", "__row"] if places else []))

    def read(self, scope: str, table: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version; one that is not there is empty if its schema is given, and NoTable otherwise."""
        entry = self.manifest(scope, version)["tables"].get(table)
        if entry is None:
            if schema is None:
                raise NoTable(f"{scope} has no table {table}")
            return self.spark.createDataFrame([], schema)
        return self.rows(entry)

    def replace(self, scope: str, tables: dict[str, DataFrame]) -> int:
        """Put whole tables in the place of stored ones, all at once; empty ones too. Other tables stay."""
        entries = {name: self.put(scope, name, df) for name, df in tables.items()}
        return self.commit(scope, lambda old: old | entries)

    def append(self, scope: str, table: str, df: DataFrame) -> int:
        entry = self.put(scope, table, df)

        def change(tables: dict) -> dict:
            old = tables.get(table)
            return tables | {table: entry if old is None else _joined(old, entry)}

        return self.commit(scope, change)

    def upsert(self, scope: str, table: str, df: DataFrame, key: str = "id") -> int:
        """Rows of df replace stored rows of the same key; the rest stay. Columns that either side lacks are null. Rows of one key within df all stay."""
        from stratagraph.plans.scratch import materialize, small

        df = materialize(df, "upserted")
        new = self.put(scope, table, df)
        keys = small(df.select(key).where(F.col(key).isNotNull()).distinct())

        def change(tables: dict) -> dict:
            old = tables.get(table)
            if old is None:
                return tables | {table: new}
            return tables | {table: self.amended(scope, table, old, keys, new)}

        return self.commit(scope, change)

    def amended(self, scope: str, table: str, old: dict, gone: DataFrame, new: dict) -> dict:
        """The entry `old` without the rows whose keys gone(key columns) names, and with those of the entry `new`. Bitmaps and `new` are all that is written, up to the bounds."""
        keys = gone.columns
        hit = self.rows(old, places=True).select(*keys, "__file", "__row").join(gone, keys, "left_semi")
        bits = hit.groupBy("__file", B.bucket(F.col("__row")).alias("__bucket")).agg(F.bitmap_construct_agg(B.place(F.col("__row"))).alias("__bits"))
        folder = f"data/{scope}/{table}/{uuid.uuid4().hex}"
        bits.write.parquet(f"{self.files.root}/{folder}")
        n = self.spark.read.schema(bits.schema).parquet(f"{self.files.root}/{folder}").count()
        entry = _joined(old, new)
        if n:
            entry |= {"deletes": old["deletes"] + [folder], "buckets": old["buckets"] + n}
        if len(entry["data"]) > PARTS or entry["buckets"] > BUCKETS:
            # Bitmaps name files, so what is new cannot be hit by those made for what is old.
            entry = self.put(scope, table, self.rows(entry).select(*T.StructType.fromJson(entry["schema"]).names))
        return entry

    def compact(self, scope: str, table: str, rewrite: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Rewrite a table as one folder without bitmaps; a concurrent change of it makes the work start anew."""

        def change(tables: dict) -> dict:
            return tables | {table: self.put(scope, table, rewrite(self.rows(tables[table])))}

        return self.commit(scope, change)

    def parts(self, scope: str, table: str) -> int:
        """Folders that a read of the table opens."""
        entry = self.manifest(scope)["tables"].get(table)
        return len(entry["data"]) + len(entry["deletes"]) if entry else 0

    # Clean-up ----------------------------------------------------------------

    def vacuum(self, scope: str, keep: int = KEEP, grace: float = GRACE) -> list[str]:
        """Delete all versions but the last `keep`, then folders that no version left names and that are older than `grace` seconds; those folders.

        Manifests go first, so a reader never finds a version whose rows are gone.
        """
        numbers = self.numbers(scope)
        stay = numbers[-max(1, keep) :]
        used = {f for n in stay for e in self.manifest(scope, n)["tables"].values() for f in e["data"] + e["deletes"]}
        for n in numbers[: -max(1, keep)]:
            self.files.delete(f"versions/{scope}/{n:012d}.json")
        gone = []
        for table, _ in self.files.names(f"data/{scope}"):
            for folder, changed in self.files.names(f"data/{scope}/{table}"):
                name = f"data/{scope}/{table}/{folder}"
                if name not in used and time.time() - changed >= grace:
                    self.files.delete(name)
                    gone.append(name)
        return gone

    def drop(self, scope: str) -> None:
        """All versions, then all rows, of a scope; nothing to drop is no error."""
        self.files.delete(f"versions/{scope}")
        self.files.delete(f"data/{scope}")


def _joined(old: dict, new: dict) -> dict:
    """An entry with the rows of both; the schema has the columns of both."""
    fields = {f["name"] for f in old["schema"]["fields"]}
    schema = old["schema"] | {"fields": old["schema"]["fields"] + [f for f in new["schema"]["fields"] if f["name"] not in fields]}
    return old | {"data": old["data"] + new["data"], "schema": schema}
