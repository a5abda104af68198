"""Incremental transcript ingestion: JSON lines arrive as files, summaries keep running.

Every line is an object that carries its own ``pos`` and may name its ``session``; otherwise
``session-<id>`` in the file path identifies it.
Entries go through the batch normalization, so the running summary equals the batch one.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.sources import transcripts as S


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming lines with the session id of their path, if it names one."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder)
    session = F.regexp_extract(F.col("_metadata.file_path"), r"session-(\d+)", 1).try_cast("long")
    return lines.select(session.alias("session_id"), F.col("value"))


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects): parsed lines with their position, and the malformed ones."""
    filled = lines.filter(F.trim("value") != "").withColumn("entry", F.try_parse_json("value"))
    position = F.try_variant_get("entry", "$.pos", "long")
    session = F.coalesce(F.try_variant_get("entry", "$.session", "long"), F.col("session_id"))
    entries = filled.filter("entry is not null").select(
        session.alias("session_id"), position.alias("pos"), F.concat(F.lit("line "), position + 1).alias("position"), "entry")
    return entries, filled.filter("entry is null").select("session_id", "value")


def summary_of(entries: DataFrame) -> DataFrame:
    """Events, commands and time span per session."""
    events = S.session_entries(entries)
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "command").alias("commands"),
        F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))


def run_available(spark: SparkSession, folder: str, checkpoint: str, rejects_path: str, summary_path: str) -> None:
    """Processes what has arrived, one read of it for both outputs.

    Every micro-batch owns the folder of its number in each output and replaces it whole, so a batch
    that runs again after a failure leaves the same tables, and what earlier batches wrote is never
    touched.  The stream itself keeps no state: a session's figures are sums over its batches
    (``read_summary``), however late a line comes.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        entries, rejects = split_lines(batch)
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        summary_of(entries).write.mode("overwrite").parquet(f"{summary_path}/batch={number}")
        batch.unpersist()

    stream = read_lines(spark, folder).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def read_summary(spark: SparkSession, summary_path: str) -> DataFrame:
    """The summary of all batches so far, one row per session."""
    parts = spark.read.parquet(summary_path)
    return parts.groupBy("session_id").agg(
        F.sum("events").alias("events"), F.sum("commands").alias("commands"), F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"))


def compact(spark: SparkSession, summary_path: str, target: str) -> None:
    """Writes the summary of all batches as one batch of a new folder, for readers of long streams."""
    read_summary(spark, summary_path).write.mode("overwrite").parquet(f"{target}/batch=0")
