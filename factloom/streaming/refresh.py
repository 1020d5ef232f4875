"""Optional: follow a folder of source files with Structured Streaming.

Each micro-batch of new or rewritten files is diffed by hash against the stored hashes and handed to a
callback with the files that really changed. Files are read once each, so a restart from the checkpoint
repeats at most the last batch, whose files then count as unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import by_extension

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, language, text, content_hash) of files as they appear."""
    raw = spark.readStream.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", "true").load(folder)
    text = raw.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text"))
    return text.select("file_path", by_extension(F.col("file_path")).alias("language"), "text", F.sha2("text", 256).alias("content_hash")).where("language is not null")


def follow(spark: SparkSession, folder: str, checkpoint: str, hashes: Callable[[], DataFrame], changed: Callable[[DataFrame, int], None]):
    """Starts the stream; `hashes` gives the stored (file_path, content_hash), `changed` takes the batch's real changes."""

    def batch(files: DataFrame, number: int) -> None:
        new = files.join(hashes().select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")
        if not new.isEmpty():
            changed(new, number)

    return file_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
