"""Parsers as a table function over files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.javascript_source import parse_javascript
from stratagraph.functions.python_source import parse_python
from stratagraph.operators.resolution import resolve_calls, resolve_imports, resolve_inheritance
from stratagraph.operators.sections import sections
from stratagraph.plans.scratch import materialize

PARSERS = {"python": parse_python, "javascript": parse_javascript, "typescript": parse_javascript}
_ROW = "repository_id string, file_path string, language string, kind string, type string, name string, start int, end int, code string, docstring string, signature string, parent string, decorators array<string>, bases array<string>, calls array<string>, module string, names array<string>, relative boolean, callee string, pos int"
_FIELDS = ["type", "name", "start", "end", "code", "docstring", "signature", "parent", "decorators", "bases", "calls", "module", "names", "relative", "callee"]


@dataclass(frozen=True)
class Parsed:
    entities: DataFrame
    imports: DataFrame
    calls: DataFrame
    inherits: DataFrame
    errors: DataFrame


def parse_rows(files: DataFrame) -> DataFrame:
    """One pass over source files; a file that a parser cannot read becomes one row of kind `error`, never a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    rows = PARSERS[r.language](r.file_path, r.text or "")
                except Exception as e:  # one bad file must not fail the rest
                    rows = [{"kind": "error", "name": type(e).__name__}]
                out += [[r.repository_id, r.file_path, r.language, x["kind"], *[x.get(f) for f in _FIELDS], k] for k, x in enumerate(rows)]
            yield pd.DataFrame(out, columns=["repository_id", "file_path", "language", "kind", *_FIELDS, "pos"])

    return files.where(F.col("language").isin(list(PARSERS))).select("repository_id", "file_path", "language", "text").mapInPandas(run, _ROW)


def parse_unresolved(files: DataFrame, first_seq: int = 0) -> Parsed:
    """All rows of a tree; seq ascends within a file, and is not under `first_seq` for what a parser gave."""
    rows = materialize(parse_rows(files).withColumn("seq", F.monotonically_increasing_id() + F.lit(first_seq)), "parsed")  # read six times, and not to be parsed anew where an executor is lost
    none = lambda t: F.lit(None).cast(t)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    code = rows.where("kind = 'entity'").select(
        "repository_id", "file_path", "language", F.col("type").alias("entity_type"), F.col("name").alias("entity_name"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("code").alias("source_code"),
        F.col("parent").alias("parent_name"), "signature", "docstring", some("decorators").alias("decorators"), some("bases").alias("base_classes"), some("calls").alias("calls"), "pos", "seq",
    )
    docs = sections(files.where("language = 'markdown'")).select(
        "repository_id", "file_path", F.lit("markdown").alias("language"), F.lit("doc_section").alias("entity_type"), "entity_name", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "source_code",
        none("string").alias("parent_name"), none("string").alias("signature"), none("string").alias("docstring"), some(none("array<string>")).alias("decorators"), some(none("array<string>")).alias("base_classes"),
        some(none("array<string>")).alias("calls"), F.col("start_line").cast("int").alias("pos"), F.col("start_line").cast("long").alias("seq"),
    )
    entities = code.unionByName(docs).drop("pos")
    own = rows
    imports = own.where("kind = 'import'").select("repository_id", "seq", F.col("file_path").alias("source_file"), "module", some("names").alias("imported_names"), F.col("start").alias("line"), F.col("relative").alias("is_relative"))
    calls = own.where("kind = 'call'").select("repository_id", "seq", F.col("file_path").alias("caller_file"), F.col("name").alias("caller_name"), F.col("type").alias("caller_type"), F.col("callee").alias("callee_name"), F.col("start").alias("line"))
    inherits = own.where("kind = 'inherit'").select("repository_id", "seq", F.col("file_path").alias("child_file"), F.col("name").alias("child_class"), F.col("callee").alias("parent_class"))
    return Parsed(entities, imports, calls, inherits, rows.where("kind = 'error'").select("repository_id", "file_path", F.col("name").alias("error")))


def known_paths(entities: DataFrame) -> DataFrame:
    """Files that an import can mean: those with an entity."""
    return entities.select("repository_id", F.col("file_path").alias("path")).distinct()


def parse_repository(files: DataFrame) -> Parsed:
    """All rows of a tree with imports, calls and inheritance resolved; seq ascends within a file."""
    p = parse_unresolved(files)
    imports = materialize(resolve_imports(p.imports, known_paths(p.entities)), "resolved_imports")  # read for calls and base classes too
    return Parsed(p.entities, imports, resolve_calls(p.calls, p.entities, imports), resolve_inheritance(p.inherits, p.entities, imports), p.errors)
