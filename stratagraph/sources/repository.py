"""Repository trees as DataFrames: file scan, languages, frameworks, line ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import paths as P
from stratagraph.plans.scratch import materialize

MAX_FILE_BYTES, SNIFF_BYTES, MAX_LINES, PREVIEW_BYTES = 1_000_000, 4_096, 120, 400_000
FRAMEWORK_FILES = 400
#: Folders that a task lists in one round, rows that it hands on at a time; bytes of files that a task reads, what opening one counts as, and files of one batch.
FOLDERS_A_TASK, LISTED_ROWS, TASK_BYTES, OPEN_BYTES, READ_ROWS = 500, 10_000, 32 << 20, 16 << 10, 16
# Dependency manifests, and words that reveal a framework.
MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "package.json", "pom.xml", "build.gradle", "go.mod", "Cargo.toml", "Gemfile"]
FRAMEWORKS = {
    "FastAPI": ["fastapi"], "Django": ["django"], "Flask": ["flask"], "Pyramid": ["pyramid"], "SQLAlchemy": ["sqlalchemy"], "Pydantic": ["pydantic"], "PyTorch": ["torch"], "TensorFlow": ["tensorflow"],
    "scikit-learn": ["scikit-learn", "sklearn"], "Pandas": ["pandas"], "Celery": ["celery"], "React": ["react"], "Next.js": ["next"], "Vue": ["vue"], "Angular": ["@angular/core"], "Express": ["express"],
    "Spring": ["spring-boot", "springframework"], "Rails": ["rails"],
}


def is_binary(content: Column) -> Column:
    """A zero byte among the first 4,096; null counts as binary."""
    return F.coalesce(F.instr(F.substring(content, 1, SNIFF_BYTES).cast("string"), "\x00") > 0, F.lit(True))


def _opened(root: str):
    """(file system, base path) of a root for a worker."""
    import pyarrow.fs as afs

    return afs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:/", root) else (afs.LocalFileSystem(), root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files under root that are not too large, by one listing of each folder; ignored folders are not entered, symbolic links not followed.

    Executors list: a task goes down from its folders until it has listed FOLDERS_A_TASK, and leaves what is below for the next round, which
    deals it out anew. Rounds are written, so no list of files or folders is on the driver.
    """
    most, budget, ignored_folders = MAX_FILE_BYTES, FOLDERS_A_TASK, frozenset(P.IGNORED_FOLDERS)

    def listed(batches):
        import os
        from collections import deque

        import pandas as pd
        import pyarrow.fs as afs

        fs, base = _opened(root)
        base, left = base.rstrip("/"), budget
        for batch in batches:
            todo, out = deque(batch["path"]), []
            while todo and left > 0:
                folder, left = todo.popleft(), left - 1
                for f in fs.get_file_info(afs.FileSelector(f"{base}/{folder}".rstrip("/") or "/", allow_not_found=bool(folder))):
                    if isinstance(fs, afs.LocalFileSystem) and os.path.islink(f.path):
                        continue
                    path = f"{folder}/{f.base_name}".lstrip("/")
                    if f.type == afs.FileType.Directory:
                        if f.base_name not in ignored_folders:
                            todo.append(path)
                    elif f.type == afs.FileType.File and f.size <= most:
                        out.append((path, f.size, False))
                if len(out) >= LISTED_ROWS:
                    yield pd.DataFrame(out, columns=["path", "length", "folder"])
                    out = []
            yield pd.DataFrame(out + [(path, 0, True) for path in todo], columns=["path", "length", "folder"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = materialize(level.repartition("path").mapInPandas(listed, "path string, length long, folder boolean"), "listed")
        here = found.where("not folder").select("path", "length")
        files = here if files is None else files.unionByName(here)
        level = found.where("folder").select("path")
        if not level.limit(1).count():
            return files


def read_named(root: str, names: DataFrame) -> DataFrame:
    """(path, length, content) of named files under root, read by the executors; content is null for a binary file, of which no more than the first 4,096 bytes are read, and for one that is gone.

    Names are dealt out by the bytes that they stand for: a file has a megabyte at most, so tasks differ little.
    """
    total = names.agg(F.coalesce(F.sum(F.col("length") + OPEN_BYTES), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_BYTES))

    def read(batches):
        import pandas as pd

        fs, base = _opened(root)
        for batch in batches:
            paths, lengths = list(batch["path"]), list(batch["length"])
            for at in range(0, len(paths), READ_ROWS):
                content = []
                for name in paths[at : at + READ_ROWS]:
                    try:
                        with fs.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                            head = f.read(SNIFF_BYTES)
                            content.append(None if b"\0" in head else head + f.read())
                    except FileNotFoundError:
                        content.append(None)
                yield pd.DataFrame({"path": paths[at : at + READ_ROWS], "length": lengths[at : at + READ_ROWS], "content": content})

    return names.select("path", "length").repartition(tasks, "path").mapInPandas(read, "path string, length long, content binary")


def listed_files(spark: SparkSession, root: str, respect_gitignore: bool = True) -> DataFrame:
    """(path, length) of the files that a scan opens: ignored ones are gone."""
    names = listing(spark, root)
    extra: list[str] = []
    if respect_gitignore and (own := read_named(root, names.where("path = '.gitignore'")).select(F.decode("content", "utf-8")).first()):
        extra = P.gitignore_globs(own[0] or "")
    return names.where(~P.ignored(F.col("path"), extra))


def file_rows(root: str, names: DataFrame, repository_id: str) -> DataFrame:
    """files(repository_id, file_path, language, length, text, digest) of named files; binary ones have no row. `digest` is of the bytes of the file."""
    kept = read_named(root, names).where("content is not null").withColumnRenamed("path", "file_path")
    return kept.select(
        F.lit(repository_id).alias("repository_id"), "file_path", P.language(F.col("file_path")).alias("language"), "length",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("digest"),
    )


def scan(spark: SparkSession, root: str, repository_id: str, respect_gitignore: bool = True, only: Column | str | None = None) -> DataFrame:
    """files(repository_id, file_path, language, length, text, digest) of a folder as if it were cloned.

    The tree is listed once; size limit and ignored paths go before any file is opened, and each file is one row. `only` is a
    condition on file_path, language and length: files that it leaves out are not opened either, as no plan would push a later `where` below the read.
    """
    names = listed_files(spark, root, respect_gitignore)
    if only is not None:
        told = names.select(F.col("path").alias("file_path"), P.language(F.col("path")).alias("language"), "length")
        names = told.where(only).select(F.col("file_path").alias("path"), "length")
    return file_rows(root, names, repository_id)


def source_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(P.CODE_LANGUAGES))


def documentation_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(P.DOC_LANGUAGES))


def language_counts(files: DataFrame) -> DataFrame:
    """L2: files a known language, most first, ties by name."""
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def lines(text: Column) -> Column:
    """Lines of a text; the empty piece after a final line end is dropped."""
    parts = F.split(text, "\r\n|\r|\n")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def frameworks(files: DataFrame) -> DataFrame:
    """L3: (repository_id, framework) with a marker word in a root manifest, or in an import line of the first 400 sources by path."""
    from pyspark.sql import Window

    manifests = files.where(F.col("file_path").isin(MANIFESTS)).select("repository_id", F.lower("text").alias("line"))
    nth = F.row_number().over(Window.partitionBy("repository_id").orderBy("file_path"))
    first = source_files(files).withColumn("__n", nth).where(F.col("__n") <= FRAMEWORK_FILES)  # a group limit: a task keeps no more of a repository
    imports = first.select("repository_id", F.explode(lines(F.col("text"))).alias("line")).where(F.col("line").rlike("^(import |from )")).select("repository_id", F.lower("line").alias("line"))
    marks = [(name, r"\b(?:" + "|".join(P.glob_regex(m) for m in words) + r")\b") for name, words in FRAMEWORKS.items()]
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in marks]), lambda x: x.isNotNull())
    return manifests.unionByName(imports).select("repository_id", F.explode(hits).alias("framework")).distinct()


def read_lines(items: DataFrame, files: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Items with content from their line range, cut to max_lines and the end of the file, with a marker where cut.

    Files are matched by repository and path only, so a path cannot leave its tree. Items without lines or file keep theirs.
    """
    wanted = items.select("repository_id", "file_path").distinct()
    held = files.join(wanted, ["repository_id", "file_path"], "left_semi").select("repository_id", "file_path", lines(F.col("text")).alias("__lines"))
    n = F.least(F.col("end_line"), F.size("__lines")) - F.col("start_line") + 1
    shown = F.least(n, F.lit(max_lines))
    text = F.concat(F.array_join(F.slice("__lines", F.col("start_line"), F.greatest(shown, F.lit(0))), "\n"), F.when(n > max_lines, "\n... (truncated)").otherwise(""))
    found = F.col("__lines").isNotNull() & (F.col("start_line") > 0) & (n > 0)
    return items.join(held, ["repository_id", "file_path"], "left").withColumn("content", F.when(found, text).otherwise(F.col("content"))).drop("__lines").select(*items.columns)


def read_file(files: DataFrame, repository_id: str, file_path: str, max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """One file with its line count; no row for an absent path, for one outside the tree, or for one too large."""
    bad = ".." in file_path.split("/") or file_path.startswith("/")
    one = files.where((F.col("repository_id") == repository_id) & (F.col("file_path") == file_path) & (F.col("length") <= max_bytes) & F.lit(not bad))
    return one.select("repository_id", "file_path", "language", "text", F.size(lines(F.col("text"))).alias("line_count"))
