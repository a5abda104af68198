"""Development-session transcripts: summaries, decisions, commands, test output, debugging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commands as S
from repochron.functions import text as T
from repochron.operators import evidence as E
from repochron.operators import ranking

SESSION = ["repo_id", "session_id", "file"]


def session_summary(events: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    rows = events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("events"), F.count_if((F.col("kind") == "command") & F.col("command").isNotNull()).alias("commands"),
        F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"), F.min_by(F.struct("id", "ts"), "pos").alias("first_event"))
    none = F.array().cast("array<string>")
    if warnings is None:
        return rows.withColumn("warnings", none)
    return rows.join(warnings, "session_id", "left").withColumn("warnings", F.coalesce("warnings", none))


def _evidence(statement: Column, excerpt: Column) -> Column:
    return E.draft("documented", "session", statement, kind="session", file=F.col("file"), event_id=F.col("id"), timestamp=F.col("ts"), role=F.col("role"), excerpt=excerpt)


def _named(rest) -> Column:
    return F.concat(F.lit("Session "), T.code_span("file"), rest if isinstance(rest, Column) else F.lit(rest))


# ---------------------------------------------------------------------- decisions
def spoken(events: DataFrame) -> DataFrame:
    """Candidate sentences of every message, exploded with their place."""
    messages = events.filter("kind = 'message'")
    return messages.select(*SESSION, "pos", "id", "role", "ts", F.posexplode(T.spoken_sentences("text")).alias("spos", "sentence"))


def decision_sentences(events: DataFrame) -> DataFrame:
    return spoken(events).filter(T.states_decision("sentence")).withColumn("key", T.decision_key("sentence"))


def accepted_sentences(qualifying: DataFrame) -> DataFrame:
    """Distinct decision sentences: at most two per message, twelve per case study, in order.

    The rule is a fold over messages.  Only a bounded part of the rows can matter: every
    message that holds the first occurrence of some sentence accepts at least one, so the
    first twelve such messages settle the outcome; and a sentence is passed over at most six
    times (each time two others are accepted), so its first seven messages suffice.
    """
    place = F.struct("session_id", "pos")
    firsts = qualifying.groupBy("repo_id", "key").agg(F.min(place).alias("at"))
    opening = firsts.select("repo_id", "at").distinct()
    considered = ranking.first_rows(opening, ["repo_id"], [F.col("at")], rules.MAX_SESSION_DECISIONS).groupBy("repo_id").agg(F.max("at").alias("last"))
    keys = firsts.join(considered, "repo_id").filter(F.col("at") <= F.col("last")).select("repo_id", "key", "last")
    rows = qualifying.join(keys, ["repo_id", "key"]).filter(place <= F.col("last"))
    once = rows.groupBy("repo_id", "key", "session_id", "pos").agg(F.min("spos").alias("spos"))
    bounded = ranking.first_rows(once, ["repo_id", "key"], [F.col("session_id"), F.col("pos")], 1 + rules.MAX_SESSION_DECISIONS // rules.MAX_DECISIONS_PER_EVENT)
    ordered = bounded.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "pos", "spos", "key"))).alias("rows"))
    row_type = "struct<session_id:bigint,pos:bigint,spos:int,key:string>"
    start = F.array().cast(f"array<{row_type}>")

    def accept(taken: Column, row: Column) -> Column:
        known = F.exists(taken, lambda t: t["key"] == row["key"])
        here = F.size(F.filter(taken, lambda t: (t["session_id"] == row["session_id"]) & (t["pos"] == row["pos"])))
        full = F.size(taken) >= rules.MAX_SESSION_DECISIONS
        return F.when(known | full | (here >= rules.MAX_DECISIONS_PER_EVENT), taken).otherwise(F.array_append(taken, row)).cast(f"array<{row_type}>")

    folded = ordered.select("repo_id", F.posexplode(F.aggregate("rows", start, accept)).alias("n", "r"))
    taken = folded.select("repo_id", (F.col("n") + 1).cast("long").alias("ord"), "r.session_id", "r.pos", "r.spos", "r.key")
    return qualifying.join(taken, ["repo_id", "session_id", "pos", "spos", "key"])


def session_decisions(events: DataFrame) -> DataFrame:
    rows = accepted_sentences(decision_sentences(events))
    s = F.col("sentence")
    item = _evidence(_named(F.concat(F.lit(' records: "'), T.truncate(s, 200), F.lit('"'))), T.truncate(s, 280))
    who = F.when(F.col("role").isNotNull(), F.concat(F.lit(" ("), F.col("role"), F.lit(")"))).otherwise("")
    return rows.select(
        "repo_id", "ord", "session_id", T.truncate(s, 110).alias("title"), F.lit("documented").alias("status"),
        F.when(F.length(s) > 110, T.truncate(s, 280)).alias("detail"),
        F.concat(F.lit("Development session "), T.code_span("file"), F.lit(", "), F.col("id"), who).alias("basis"),
        F.substring("ts", 1, 10).alias("date"), E.drafts(item).alias("drafts"))


# ---------------------------------------------------------------------- findings
def session_commands(events: DataFrame) -> DataFrame:
    """Up to four purposeful commands per session with their counts (once per event)."""
    commands = events.filter("kind = 'command' and command is not null").select(*SESSION, "pos", "id", "role", "ts", "command")
    # Collapse repeats before anything else: event, key -> one row.
    keys = F.array_distinct(F.array_compact(F.transform(S.segments("command"), S.command_key)))
    used = commands.select(*SESSION, "pos", "id", "role", "ts", F.explode(keys).alias("key"))
    counted = used.groupBy(*SESSION, "key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("pos", "id", "role", "ts"), "pos").alias("first"))
    notable = counted.filter(F.size(S.purposes_of_text(S.substitute_variables("key"))) > 0)
    return ranking.first_rows(notable, SESSION, [F.col("n").desc(), F.col("first.pos"), F.col("key")], 4)


def command_findings(events: DataFrame) -> DataFrame:
    per_session = events.filter("kind = 'command' and command is not null").groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("total"), F.min_by(F.struct("pos", "id", "role", "ts", "command"), "pos").alias("first"))
    times = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n"), F.lit("×)"))).otherwise("")
    repeated = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n"), F.lit(" times)"))).otherwise("")
    notable = session_commands(events).select(*SESSION, "rank", "key", "n", "first.id", "first.role", "first.ts")
    item = _evidence(_named(F.concat(F.lit(" records the command "), T.code_span("key"), repeated, F.lit("."))), F.col("key"))
    shown = notable.select(*SESSION, "rank", F.concat(T.code_span("key"), times).alias("word"), item.alias("d")).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"), F.collect_list(F.struct("rank", "d")).alias("ds"))
    joined = per_session.join(shown, SESSION, "left").select(*SESSION, "total", "first.id", "first.role", "first.ts", F.col("first.command").alias("command"), "w", "ds")
    words = F.transform("w", lambda x: x["word"])
    n = F.col("total")
    text = F.concat(_named(F.concat(F.lit(" records "), n, F.lit(" command"), T.plural_suffix(n))),
                    F.when(F.size("w") > 0, F.concat(F.lit(", including "), T.join_words(words))).otherwise(""), F.lit("."))
    fallback = E.drafts(_evidence(_named(F.concat(F.lit(" records "), n, F.lit(" commands."))), T.truncate("command", 120)))
    by_rank = F.transform(F.array_sort("ds", lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)), lambda x: x["d"])
    return joined.select(*SESSION, F.lit(20).alias("slot"), text.alias("text"), F.coalesce(by_rank.cast(E.DRAFTS_TYPE), fallback).alias("drafts"))


def session_test_runs(events: DataFrame) -> DataFrame:
    """Recognized test outputs per session and the latest one; result events win over messages."""
    has_result = events.groupBy(*SESSION).agg(F.bool_or(F.col("kind") == "result").alias("_r"))
    spoken_kinds = events.filter("kind in ('result', 'message')").withColumn("summary", S.test_summary("text")).filter("summary is not null")
    wanted = spoken_kinds.join(has_result, SESSION).filter(F.col("kind") == F.when(F.col("_r"), "result").otherwise("message"))
    return wanted.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("runs"), F.max_by(F.struct("id", "role", "ts", "summary"), "pos").alias("l")).select(
        *SESSION, "runs", "l.id", "l.role", "l.ts", F.col("l.summary").alias("last_summary"))


def test_findings(events: DataFrame) -> DataFrame:
    rows = session_test_runs(events)
    n, s = F.col("runs"), F.col("last_summary")
    at = F.when(F.col("ts").isNotNull(), F.concat(F.lit(" at "), F.substring(F.replace("ts", F.lit("T"), F.lit(" ")), 1, 16), F.lit(" UTC"))).otherwise("")
    text = _named(F.concat(F.lit(" records "), n, F.lit(" test run"), T.plural_suffix(n), F.lit("; the last recorded output"), at, F.lit(" reads “"), s, F.lit("”.")))
    item = _evidence(_named(F.concat(F.lit(' records test output: "'), s, F.lit('".'))), s)
    return rows.select(*SESSION, F.lit(21).alias("slot"), text.alias("text"), E.drafts(item).alias("drafts"))


def session_debug_notes(events: DataFrame) -> DataFrame:
    """First debugging sentence per message, five messages per session."""
    notes = events.filter("kind = 'message'").withColumn(
        "sentence", F.try_element_at(F.filter(T.spoken_sentences("text"), T.is_debugging_note), F.lit(1))).filter("sentence is not null")
    return ranking.first_rows(notes.select(*SESSION, "pos", "id", "role", "ts", "sentence"), SESSION, [F.col("pos")], rules.MAX_DEBUGGING_NOTES)


def debugging_findings(events: DataFrame) -> DataFrame:
    rows = session_debug_notes(events)
    excerpt = T.truncate("sentence", 240)
    return rows.select(*SESSION, (F.lit(30) + F.col("rank")).alias("slot"),
                       F.concat(F.lit("Debugging note from "), T.code_span("file"), F.lit(": “"), excerpt, F.lit("”")).alias("text"),
                       E.drafts(_evidence(_named(" records a debugging note."), excerpt)).alias("drafts"))


def session_findings(events: DataFrame) -> DataFrame:
    rows = command_findings(events).select("*").unionByName(test_findings(events)).unionByName(
        debugging_findings(events).withColumn("slot", F.col("slot").cast("int")))
    return rows.select("repo_id", F.lit("session").alias("area"), (F.lit(1 << 40) + F.col("session_id") * 64 + F.col("slot")).alias("ord"), "text",
                       F.lit("documented").alias("level"), "drafts")
