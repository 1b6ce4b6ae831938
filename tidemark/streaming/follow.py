"""Streams of log lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import appended

# The columns that put the lines of followed files in order, file by file as they arrived.
FILE_ORDER = ("file_time", "file", "split_start")


def follow_text(spark: SparkSession, folder: str, since: datetime | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New lines of a log that grows by whole files in ``folder``; files older than ``since`` (UTC) are passed over.

    The log is the folder, and its lines follow the files' modification times and names. Move files in when they are
    complete, as for any streamed folder. Give ``since`` as the current time to start at the log's present end.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(folder)
        .select(
            F.lit(folder).alias("source"),
            F.unix_micros("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.make_valid_utf8("value").alias("line"),
        )
    )
    if since is not None:
        micros = int((since - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        lines = lines.filter(F.col("file_time") >= micros)
    return lines


def follow_appended(spark: SparkSession, path: str, from_end: bool = False, partition_bytes: int | None = None) -> DataFrame:
    """Lines appended to the files of a folder or pattern, each file a log of its own; new files are taken in too.

    A line counts once it has its end; what is written of it before is held back. ``from_end`` passes over the lines
    that the files hold when the stream is first started. Restarts go on where the last batch ended. Files must be
    readable by the tasks' own processes (local and shared folders, and the stores that Arrow opens). A file that has become
    shorter is read anew from its beginning; one that was replaced by a longer one is not told apart.
    """
    appended.register(spark)
    reader = spark.readStream.format(appended.NAME).option("path", path).option("start", "latest" if from_end else "earliest")
    if partition_bytes:
        reader = reader.option("partitionBytes", partition_bytes)
    return reader.load()


def messages(stream: DataFrame, source: str, seq: str, message: str) -> DataFrame:
    """Any stream of messages as log lines; ``seq`` must order the messages of a source, as an offset does."""
    return stream.select(
        F.expr(source).cast("string").alias("source"),
        F.expr(seq).cast("bigint").alias("seq"),
        F.expr(message).cast("string").alias("line"),
    )
