"""Export texts rebuilt from the derived tables: logs, listings and transcript files.

Each text holds a bounded slice (500 commits, 200 turns, one directory), so no history or
conversation is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.plans.corpus import Corpus
from repochron.sources.git_exports import RECORD_MARKER

NUL = "\0"
PART_COMMITS, CHUNK_TURNS = 500, 200


def log_dumps(c: Corpus) -> DataFrame:
    """(repo_id, part, content): commit logs, newest first, in parts of 500 commits."""
    renamed = F.col("previous_path").isNotNull()
    letter = F.when(F.col("status") == "added", "A").when(F.col("status") == "deleted", "D").when(renamed, "R100").otherwise("M")
    old = F.when(renamed, F.concat("previous_path", F.lit(NUL))).otherwise("")
    raw = F.concat(F.lit(":100644 100644 aaaa bbbb "), letter, F.lit(NUL), old, "path", F.lit(NUL))
    count = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-"))
    counts = F.concat(count("additions"), F.lit("\t"), count("deletions"), F.lit("\t"), F.when(renamed, F.lit(NUL)).otherwise(""), old, "path", F.lit(NUL))
    # texts are made of the columns behind the shuffle, which would carry each path up to four times
    rows = c.changes().repartition("repo_id", "sha").select("repo_id", "sha", F.struct("pos", "path", raw.alias("raw"), counts.alias("counts")).alias("e"))
    entries = lambda field: F.array_join(F.transform(F.array_sort("e"), lambda e: e[field]), "")
    changes = rows.groupBy("repo_id", "sha").agg(F.collect_list("e").alias("e")).select(
        "repo_id", "sha", F.concat(F.lit("\n"), entries("raw"), entries("counts")).alias("tail"))
    parents = F.array_join(F.transform(F.slice(F.array(F.lit("p0"), F.lit("p1")), F.lit(1), "n_parents"), lambda p: F.concat(p, F.col("short_sha"))), " ")
    fields = [F.lit(RECORD_MARKER), F.col("sha"), F.col("short_sha"), parents, F.col("author_name"), F.col("authored_raw"), F.col("subject"), F.concat("body", F.lit("\n")), F.lit("")]
    record = F.concat(F.concat_ws(NUL, *fields), F.coalesce("tail", F.lit("")))
    rows = c.commits().join(changes, ["repo_id", "sha"], "left").select("repo_id", "seq", record.alias("record"))
    part = (F.lit(1_000_000) - F.floor(F.col("seq") / PART_COMMITS)).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), "record"))), lambda r: r["record"]), "")
    return rows.groupBy("repo_id", part.alias("part")).agg(F.encode(text, "UTF-8").alias("content"))


def tree_listings(c: Corpus) -> DataFrame:
    """(repo_id, text): tree entries of one directory each, with a submodule among them."""
    mode = F.when(F.col("kind") == "symlink", "120000").otherwise("100644")
    size = F.lpad(F.col("size").cast("string"), 7, " ")
    entry = F.concat(mode, F.lit(" blob "), "object_id", F.lit(" "), size, F.lit("\t"), "path", F.lit(NUL))
    submodule = F.lit("160000 commit cccc       -\tmodules/dep" + NUL)
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    slot = F.pmod(F.xxhash64("path"), F.lit(64))
    return c.files().select("repo_id", folder.alias("d"), slot.alias("slot"), entry.alias("entry")).groupBy("repo_id", "d", "slot").agg(
        F.concat(F.array_join(F.collect_list("entry"), ""), submodule).alias("text")).select("repo_id", "text")


def tag_listings(c: Corpus) -> DataFrame:
    """(repo_id, text): tag lines; every second tag is annotated and peels to its commit."""
    annotated = F.expr("(pos div 40) % 2 = 0")
    line = F.concat("name", F.lit(NUL), F.when(annotated, F.sha2("name", 256)).otherwise(F.col("sha")), F.lit(NUL), F.when(annotated, F.col("sha")).otherwise(""), F.lit("\n"))
    return c.tags().groupBy("repo_id", F.expr("pos div 8000").alias("slice")).agg(F.concat(F.array_join(F.collect_list(line), ""), F.lit(NUL + NUL + "\n")).alias("text"))


def content_files(c: Corpus) -> DataFrame:
    """Document bytes: some start with a byte-order mark, some contain a NUL."""
    body = F.encode("text", "UTF-8")
    marked = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), body)).when(F.col("doc_id") % 11 == 0, F.concat(F.lit(b"\x00"), body)).otherwise(body)
    return c.raw("documents").select("doc_id", marked.alias("content"))


# ---------------------------------------------------------------------- transcripts
def _entries(c: Corpus) -> DataFrame:
    """One JSON entry per turn: plain ones, and nested ones with a tool call."""
    turn, role = F.col("turn"), F.col("role")
    plain = F.to_json(F.struct(
        F.concat(F.lit("m"), turn).alias("id"), role.alias("role"), (F.lit(1700000000) + turn * 60).alias("timestamp"), F.col("text").alias("content")))
    nested = F.to_json(F.struct(
        F.concat(F.lit("u"), turn).alias("uuid"), F.lit("event").alias("type"), F.struct(
            role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input")),
                                        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("bash").alias("name"),
                                                 F.struct(F.lit("bun test").alias("command")).alias("input"))).alias("content")).alias("message")))
    return c.raw("conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.floor(turn / CHUNK_TURNS).cast("long").alias("chunk"),
        F.when(turn % 2 == 0, plain).otherwise(nested).alias("entry"), "role", "text")


def _gather(rows: DataFrame, word, separator: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", word.alias("w")))), lambda x: x["w"])
    return rows.groupBy("conv_id", "chunk").agg(F.array_join(lines, separator).alias("text")).withColumn("session_id", F.col("conv_id") * 1_000_000 + F.col("chunk"))


def jsonl_sessions(c: Corpus) -> DataFrame:
    """JSON lines with a malformed line after every fifth turn and a blank one after every third."""
    line = F.concat(F.col("entry"), F.when(F.col("turn") % 5 == 4, "\n{broken").otherwise(""), F.when(F.col("turn") % 3 == 2, "\n").otherwise(""))
    return _gather(_entries(c), line, "\n")


def json_sessions(c: Corpus) -> DataFrame:
    """A top-level list, a container, or a container inside a container."""
    gathered = _gather(_entries(c), F.col("entry"), ",")
    entries = F.concat(F.lit("["), "text", F.lit("]"))
    kind = F.col("conv_id") % 3
    text = F.when(kind == 0, entries).when(kind == 1, F.concat(F.lit('{"title":"x","messages":'), entries, F.lit("}"))).otherwise(
        F.concat(F.lit('{"data":{"meta":{"a":1},"turns":'), entries, F.lit("}}")))
    return gathered.withColumn("text", text)


def text_sessions(c: Corpus) -> DataFrame:
    """Speaker turns; every fourth one ends in a console block."""
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("**Assistant (2024-05-01 10:30):** ")
    console = F.when(F.col("turn") % 4 == 0, "\n\n```console\n$ bun test\n12 pass\n0 fail\n```").otherwise("")
    return _gather(_entries(c), F.concat(speaker, F.col("text"), console), "\n")


def session_files(c: Corpus) -> DataFrame:
    """Transcript files of several formats, one of them binary and one over the size limit."""
    names = F.element_at(F.array(*[F.lit(e) for e in (".json", ".jsonl", ".NDJSON", ".md", ".txt")]), (F.col("conv_id") % 5 + 1).cast("int"))
    rows = jsonl_sessions(c)
    content = F.encode("text", "UTF-8")
    return rows.select(
        "session_id", F.concat(F.lit("in/session-"), "session_id", names).alias("path"),
        F.when(F.col("conv_id") % 17 == 0, 26214401).otherwise(F.octet_length("text")).cast("long").alias("size"),
        F.when(F.col("conv_id") % 13 == 0, F.concat(content, F.lit(b"\x00"))).otherwise(content).alias("content"), F.octet_length("text").alias("bytes"))


def stream_lines(c: Corpus) -> DataFrame:
    """One text line per turn that names its session, and a malformed one now and then."""
    line = F.to_json(F.struct(F.col("conv_id").cast("long").alias("session"), F.col("turn").cast("long").alias("pos"), "role", (F.lit(1700000000) + F.col("turn") * 60).alias("ts"),
                              F.when(F.col("turn") % 4 == 1, "cargo test").alias("command"), F.when(F.col("turn") % 4 != 1, F.col("text")).alias("text")))
    return c.raw("conversations").select(F.explode(F.when(F.col("turn") % 5 == 4, F.array(line, F.lit("{broken"))).otherwise(F.array(line))).alias("value"))
