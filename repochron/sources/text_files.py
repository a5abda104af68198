"""Text from file contents: binary probe, lenient UTF-8, byte-order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron import rules

PROBE_BYTES = 8192


def is_binary(content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.contains(F.substring(c, 1, PROBE_BYTES), F.lit(b"\x00"))


def decoded(content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    text = F.make_valid_utf8(c.cast("string"))
    return F.when(text.startswith("﻿"), F.substring(text, 2, 1 << 30)).otherwise(text)


def scan_text_files(files: DataFrame) -> DataFrame:
    """Adds ``text`` and, for contents that are not text, ``reason``."""
    binary = is_binary("content")
    return files.withColumns({"text": F.when(~binary, decoded("content")), "reason": F.when(binary, "binary")}).drop("content")


def session_format(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.substring_index(p, "/", -1))
    return F.when(name.rlike(r".\.json\z"), "json").when(name.rlike(r".\.(jsonl|ndjson)\z"), "jsonl").otherwise("text")


def scan_sessions(files: DataFrame) -> DataFrame:
    """Transcript files (path, size, content) -> file, format, text, reject_reason.

    Rows with a reason are the rejects table; their text is null.
    """
    reason = F.when(F.col("size") > rules.MAX_SESSION_BYTES, "too-large").when(is_binary("content"), "binary")
    return files.withColumns({
        "file": F.substring_index("path", "/", -1), "format": session_format("path"), "reject_reason": reason,
        "text": F.when(reason.isNull(), decoded("content"))}).drop("content", "path")
