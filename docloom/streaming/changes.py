"""Edited documents as a stream of files: each batch is checked against the known hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.feedback import changed_files


def watch_documents(spark: SparkSession, folder: str, known: Callable[[], DataFrame], act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call ``act`` with (path, hash, is_new) of the changed files of each batch of new files in ``folder``."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    hashed = files.select(F.col("_metadata.file_path").alias("path"), F.md5("value").alias("hash"))

    def batch(df: DataFrame, number: int) -> None:
        act(changed_files(df, known()), number)

    writer = hashed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
