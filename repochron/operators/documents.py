"""Which tracked files are read, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T


def select_documents(files: DataFrame) -> DataFrame:
    """Allow-listed files with outcome read / symlink / too-large / over-cap.

    The cap counts readable files only, by priority and path.  The first 200 of each
    repository are found with a group limit ahead of the shuffle; the rest is marked by a
    join against those, so a repository with many candidates is never sorted in one task.
    """
    candidates = files.withColumn("priority", P.read_priority("path")).filter("priority is not null").withColumn(
        "reason", F.when(F.col("kind") == "symlink", "symlink").when(F.col("size") > rules.MAX_DOCUMENT_BYTES, "too-large"))
    order = Window.partitionBy("repo_id").orderBy("priority", T.locale_key("path"), "path")
    read = (
        candidates.filter("reason is null").select("repo_id", "path", "priority")
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rules.MAX_DOCUMENTS)
        .select("repo_id", "path", F.lit(True).alias("within")))
    outcome = F.coalesce("reason", F.when(F.col("within"), "read"), F.lit("over-cap"))
    return candidates.join(read, ["repo_id", "path"], "left").select(
        "repo_id", "path", "size", "object_id", "priority", outcome.alias("outcome"))


def documents(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Text of the files to read; the selection runs before any content is joined.  Binary files have none."""
    return _contents(files, blobs).filter("text is not null")


def binary_documents(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of files to read whose content is not text."""
    return _contents(files, blobs).filter("text is null").select("repo_id", "path", F.lit("binary").alias("reason"))


def _contents(files: DataFrame, blobs: DataFrame) -> DataFrame:
    wanted = select_documents(files).filter("outcome = 'read'").select("repo_id", "path", "priority", "object_id")
    return wanted.join(blobs, ["repo_id", "object_id"]).select("repo_id", "path", "priority", "text")
