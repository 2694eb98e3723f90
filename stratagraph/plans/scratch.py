"""Intermediate results written to the shared folder, and broadcasts whose size is checked."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most (8 MB of longs); beyond that a shuffled join is used.
BROADCAST_ROWS = 1_000_000
#: Rows of a task that sorts them, about, and compressed bytes up to which small tasks are put together again.
TASK_ROWS, TASK_BYTES = 200_000, "1m"  # 1 MB of parsed rows sorts in about 144 MB
_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in this session's part of spark.checkpoint.dir; a temporary one of this machine only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = tempfile.mkdtemp(prefix="stratagraph-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/stratagraph-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = spark
        atexit.register(_remove, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def _remove(folder: str) -> None:
    """Delete a folder of the shared storage; nothing to do where the session has ended already."""
    spark = _FOLDERS.pop(folder, None)
    with contextlib.suppress(Exception):
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete all intermediate results of this session now; no DataFrame made of them can be read after that. It also happens at exit."""
    for folder in [f for f in _FOLDERS if f.endswith(f"/stratagraph-{spark.sparkContext.applicationId}")]:
        _remove(folder)


@contextlib.contextmanager
def dealt_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is written shuffles into as many tasks as that number of rows asks for, if the session's own number is lower."""
    wanted = {"spark.sql.shuffle.partitions": str(-(-rows // TASK_ROWS)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    before = {k: spark.conf.get(k) for k in wanted}
    if int(wanted["spark.sql.shuffle.partitions"]) <= int(before["spark.sql.shuffle.partitions"]):
        yield
        return
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives executors. Rows that are not all there again are an error."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}.parquet"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    # The schema is given, so a folder without its files would read as a smaller table; so would one whose files go later, where the session ignores that.
    out = spark.read.schema(df.schema).options(ignoreMissingFiles=False, ignoreCorruptFiles=False).parquet(path)
    if (found := out.count()) != written.get["rows"]:
        raise RuntimeError(f"{path}: {found} of {written.get['rows']} rows are there; spark.checkpoint.dir must name a folder that the driver and the executors share")
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast where the rows are counted to be few; beyond that a shuffled join. df is read twice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the hash of its keys in as many tasks as its number of rows asks for, so that what a task sorts does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
