"""Extension: incremental indexing of new files as a stream (the batch engine has no streaming of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratagraph.operators.parsing import parse_rows
from stratagraph.sources.store import Store

FILE_ROWS = "repository_id string, file_path string, language string, length long, text string"


def index_stream(spark: SparkSession, inbox: str, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Parse file rows (Parquet) as they arrive in `inbox` into `table`, one append a batch.

    A batch that is replayed after a failure writes the same folder again, so no row is stored twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        parse_rows(batch).write.mode("overwrite").parquet(f"{store.root}/{table}/epoch={epoch}")

    return spark.readStream.schema(FILE_ROWS).parquet(inbox).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
