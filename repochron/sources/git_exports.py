"""Readers of history exports: commit logs, tree listings and tag listings.

A history may be exported in several parts (whole commits each, newest part first).  ``read_records``
splits large parts at the record marker wherever a file block ends, so neither a history nor a
part has to fit one task; ``read_dumps`` takes small parts whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron.operators import ranking

#: first token of a record; the export command chooses it
RECORD_MARKER = "\x1eCOMMIT"
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type-changed"}
_CHANGE = "array<struct<pos:bigint,path:string,previous_path:string,status:string,additions:bigint,deletions:bigint>>"
_COLUMNS = ["repo_id", "part", "log_pos", "sha", "short_sha", "parents", "author_name", "authored_raw", "subject", "body", "changes"]
_SCHEMA = ("repo_id long, part long, log_pos long, sha string, short_sha string, parents array<string>, author_name string, "
           f"authored_raw string, subject string, body string, changes {_CHANGE}")
_COUNTS = re.compile(r"(-|\d+)\t(-|\d+)\t(.*)", re.S)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Files ``<repo_id>/<part>.log`` under ``path`` as (repo_id, part, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    place = lambda group: F.regexp_extract("path", r"(\d+)/(\d+)\.log$", group).cast("long")
    return files.select(place(1).alias("repo_id"), place(2).alias("part"), "content")


def _starts(token: str) -> Column:
    """Whether a text begins with the fields that follow a header marker: an object id and its own beginning."""
    fields = F.regexp_extract(token, r"\A([0-9a-f]{40,64})\x00([0-9a-f]{4,64})\x00", 0)
    ends = F.split(fields, r"\x00")
    return (fields != "") & F.startswith(ends[0], ends[1])


def read_records(spark: SparkSession, path: str, marker: str = RECORD_MARKER, *, place: str = r"(\d+)/(\d+)\.log$", glob: str = "*.log") -> DataFrame:
    """Records of the log files under ``path`` as (repo_id, part, log_pos, content); files are split at any block border.

    ``place`` finds the repository and the part in a file's path.  Files are read as texts that end at
    a marker.  A text that does not go on like a header follows a marker inside a field, so it is
    glued to the one before, also over a block border: starts are counted in each block, and the sums
    of the blocks before are added.  Text ahead of the first marker of a file is a record at 0, empty
    or not; markers of one file number its records.  A file that is one block (small ones, and
    compressed ones of any size) is glued in the task that reads it.
    """
    split = f"{marker}\0"
    scan = spark.read.option("lineSep", split).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    one_block = (F.col("_metadata.file_block_start") == 0) & (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size"))
    file = F.col("_metadata.file_path").alias("file")
    # files are packed by their number; small ones go together, as each task starts its own Python workers
    tasks = max(3 * spark.sparkContext.defaultParallelism, scan.rdd.getNumPartitions() // 16)
    single = scan.filter(one_block).coalesce(tasks).select(file, _starts("value").alias("starts"), F.col("value").cast("binary").alias("value")).mapInPandas(
        _glue(split.encode()), "file string, log_pos long, content binary")
    number = lambda group: F.regexp_extract("file", place, group).cast("long")
    placed = lambda df: df.select(number(1).alias("repo_id"), number(2).alias("part"), "log_pos", "content")
    if glob.endswith(".gz"):  # never split
        return placed(single)
    texts = scan.filter(~one_block).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    inside = Window.partitionBy("file", "block").orderBy("row")
    lead = (F.col("block") == 0) & (F.row_number().over(inside) == 1)
    marked = texts.withColumn("lead", lead).withColumn("starts", (~F.col("lead") & _starts("value")).cast("long")).withColumn("n", F.sum("starts").over(inside))
    # one row for each block of a file
    blocks = marked.groupBy("file", "block").agg(F.sum("starts").alias("b_starts"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("b_starts").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = marked.join(blocks.select("file", "block", "before"), ["file", "block"]).withColumn("log_pos", F.col("n") + F.col("before"))
    piece = F.struct("block", "row", F.when(F.col("lead"), F.col("value")).otherwise(F.concat(F.lit(split), "value")).cast("binary").alias("value"))
    whole = numbered.groupBy("file", "log_pos").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    content = F.aggregate("pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["value"]))
    return placed(whole.select("file", "log_pos", content.alias("content")).unionByName(single))


def _glue(split: bytes):
    """Texts of whole files, each file's in order, to its records."""
    def records_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        file, log_pos, pieces = None, 0, []
        for batch in batches:
            for here, starts, value in zip(batch["file"], batch["starts"], batch["value"]):
                if here == file and not starts:
                    pieces += (split, value)
                    continue
                if pieces:
                    yield file, log_pos, b"".join(pieces)
                file, log_pos, pieces = (file, log_pos + 1, [split, value]) if here == file else (here, 0, [value])
        if pieces:
            yield file, log_pos, b"".join(pieces)

    def glue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in itertools.batched(records_of(batches), _BATCH):
            yield pd.DataFrame(rows, columns=["file", "log_pos", "content"])

    return glue


def _count(text: str) -> int | None:
    return None if text == "-" else int(text)


#: tokens of a header: the marker and seven fields
_HEADER = 8
_SHA = re.compile("[0-9a-f]{40,64}")


def record_starts(tokens: list[str], marker: str) -> list[int]:
    """Places of the header markers: a marker is one if an object id and its own beginning follow."""
    following = zip(tokens, tokens[1:], tokens[2:])
    return [i for i, (token, sha, short) in enumerate(following) if token.removeprefix("\n") == marker and _SHA.fullmatch(sha) and len(short) >= 4 and sha.startswith(short)]


def _changes(tokens: list[str]) -> list[dict]:
    """Changed files of one record, in order of their first mention; ValueError where an entry is broken."""
    found: dict[str, dict] = {}

    def entry(path: str) -> dict:
        return found.setdefault(path, {"pos": len(found), "path": path, "previous_path": None, "status": "unknown", "additions": 0, "deletions": 0})

    rest = iter(tokens)
    for token in rest:
        token = token.removeprefix("\n")
        if not token:
            continue
        counts = None if token.startswith(":") else _COUNTS.fullmatch(token)
        if counts is None and not token.startswith(":"):
            raise ValueError(f"unrecognized change {token[:40]!r}")
        status = None if counts else STATUS.get(token.rpartition(" ")[2][:1], "unknown")
        moved = status in ("renamed", "copied") if status else not counts[3]
        paths = [next(rest, None) for _ in range(1 + moved)] if status or moved else [counts[3]]
        if None in paths:
            raise ValueError(f"no path after {token[:40]!r}")
        change = entry(paths[-1])
        if moved and change["previous_path"] is None:
            change["previous_path"] = paths[0]
        change.update({"status": status} if status else {"additions": _count(counts[1]), "deletions": _count(counts[2])})
    return list(found.values())


def commit_records(content: bytes, marker: str = RECORD_MARKER) -> Iterator[tuple]:
    """(record, None) of every commit of a dump, or (None, reason) where one is broken: only that one is lost."""
    tokens = content.decode("utf-8", "replace").split("\0")
    starts = record_starts(tokens, marker)
    lead = [t for t in tokens[:starts[0] if starts else len(tokens)] if t.strip("\n")]
    if lead:
        yield None, f"expected a commit header, found {lead[0][:40]!r}"
    for start, end in zip(starts, [*starts[1:], len(tokens)]):
        header = tokens[start + 1:min(start + _HEADER, end)]
        try:
            if len(header) < _HEADER - 1:
                raise ValueError(f"broken commit header {header[0]!r}")
            sha, short, parents, author, authored, subject, body = header
            yield (sha, short, parents.split(), author, authored, subject, body.strip(), _changes(tokens[start + _HEADER:end])), None
        except ValueError as problem:
            yield None, f"{tokens[start + 1][:12]}: {problem}"


#: records of one output batch of the reader
_BATCH = 1000


def _scan(marker: str):
    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for repo_id, part, first, content in zip(batch["repo_id"], batch["part"], batch["log_pos"], batch["content"]):
                for pos, (record, reason) in enumerate(commit_records(bytes(content), marker)):
                    yield repo_id, part, first + pos, *(record or [None] * 8), reason

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in itertools.batched(rows_of(batches), _BATCH):
            yield pd.DataFrame(rows, columns=[*_COLUMNS, "reason"])

    return scan


def _scanned(dumps: DataFrame, marker: str) -> DataFrame:
    first = F.col("log_pos") if "log_pos" in dumps.columns else F.lit(0).cast("long").alias("log_pos")
    return dumps.select("repo_id", "part", first, "content").mapInPandas(_scan(marker), f"{_SCHEMA}, reason string")


def scan_commit_log(dumps: DataFrame, marker: str = RECORD_MARKER) -> DataFrame:
    """Commits with nested changes and ``seq`` (oldest 0) from whole parts or single records, newest first.

    Records that cannot be read are left out; ``rejected_records`` has them.
    """
    scanned = _scanned(dumps, marker).filter("reason is null").drop("reason")
    order = [F.col("part").desc(), F.col("log_pos").desc()]
    stretch = F.struct(-F.col("part"), -ranking.block_of("log_pos"))
    numbered = ranking.number_rows(scanned, ["repo_id"], stretch, order, "n")
    return numbered.withColumns({"seq": F.col("n") - 1, "n_parents": F.size("parents")}).drop("n", "part", "log_pos")


def rejected_records(dumps: DataFrame, marker: str = RECORD_MARKER) -> DataFrame:
    """(repo_id, part, log_pos, reason) of the records of dumps that cannot be read."""
    return _scanned(dumps, marker).filter("reason is not null").select("repo_id", "part", "log_pos", "reason")


def changes_of(scanned: DataFrame) -> DataFrame:
    return scanned.select("repo_id", "sha", "seq", F.explode("changes").alias("c")).select("repo_id", "sha", "seq", "c.*")


def scan_tree(listings: DataFrame) -> DataFrame:
    """(repo_id, text) with NUL-separated ``mode type id size<TAB>path`` entries -> files."""
    entries = listings.select("repo_id", F.explode(F.split("text", "\\x00")).alias("entry"))
    part = lambda group: F.regexp_extract("entry", r"(?s)\A(\S+) +(\S+) +(\S+) +(\S+)\t(.*)\z", group)
    return entries.filter(part(2) == "blob").select(
        "repo_id", part(5).alias("path"), F.coalesce(part(4).try_cast("long"), F.lit(0).cast("long")).alias("size"), part(3).alias("object_id"),
        F.when(part(1) == "120000", "symlink").when(part(1) == "100755", "executable").otherwise("file").alias("kind"))


def scan_tags(listings: DataFrame) -> DataFrame:
    """(repo_id, text) with ``name NUL object NUL peeled`` lines -> tags; the peeled id wins."""
    lines = listings.select("repo_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    field = lambda i: F.try_element_at(F.split("line", "\\x00", -1), F.lit(i))
    filled = lambda c: F.when(c != "", c)
    return lines.select("repo_id", filled(field(1)).alias("name"), F.coalesce(filled(field(3)), filled(field(2))).alias("sha")).filter(
        "name is not null and sha is not null")
