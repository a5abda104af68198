"""Plain-text transcripts as events, by running counts over numbered lines.

Nothing here is read line by line: every question about a line is a count of marks before it.

* A fence line opens or closes a block, so a line is inside a block if the number of fence lines up
  to it is odd, and the last fence line that came at an odd count says what kind of block it is.
* A turn begins at a speaker line, or at a blank line where nobody is named; the number of such
  lines so far numbers the turns.
* A prompt begins an output; the number of prompts so far numbers the outputs of a turn, and an
  output takes lines until the first line that ends it.

Windows lie inside one transcript, whose size the source limits (``rules.MAX_SESSION_BYTES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T

_S = f"[{rules.JS_SPACE}]"
_REST = r"([^\n\r\u2028\u2029]*)"
_ROLE = rf"({rules.ROLE_WORDS})"
_BOLD = r"(?:\*\*|__)?"
_HEADING = rf"(?i)\A{_S}{{0,3}}#{{1,6}}{_S}+{_BOLD}{_ROLE}(?![A-Za-z0-9_]){_BOLD}{_S}*{_REST}\z"
_INLINE = rf"(?i)\A{_S}{{0,3}}{_BOLD}\[?{_ROLE}\]?{_BOLD}{_S}*(?:\([^)]*\))?{_S}*{_BOLD}{_S}*[:：]{_S}*{_BOLD}{_S}*{_REST}\z"
_FENCE = rf"\A{_S}*(?:```|~~~)"
_SHELL_FENCE = rf"(?i)\A{_S}*(?:```|~~~){_S}*(?:{rules.SHELL_NAMES}){_S}*\z"
_PROMPT = rf"\A{_S}*[$>❯]{_S}+([^\n\r\u2028\u2029]+)\z"
_DOLLAR = rf"\A{_S}*\${_S}"


def _so_far(mark: Column, window, *, before: bool = False) -> Column:
    """Number of marked rows up to this one, or before it."""
    return F.coalesce(F.sum(mark.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)), F.lit(0))


def turn_lines(sessions: DataFrame) -> DataFrame:
    """(session_id, turn, word, stamp, first, number, line): the lines of every turn, the speaker's name taken off.

    turn numbers the turns, first is the number of its first line; word and stamp are the speaker and
    the time that this line names, if any.
    """
    split = sessions.select("session_id", F.posexplode(F.split(T.unix_lines("text"), "\n", -1)).alias("i", "line"))
    heading, inline = F.regexp_extract("line", _HEADING, 1), F.regexp_extract("line", _INLINE, 1)
    lines = split.select(
        "session_id", (F.col("i") + 1).cast("long").alias("number"), "line", F.when(heading != "", heading).otherwise(inline).alias("word"),
        F.when(heading != "", "").otherwise(F.regexp_extract("line", _INLINE, 2)).alias("rest"),
        F.col("line").rlike(_FENCE).alias("fence"), (T.trim("line") == "").alias("blank"))
    whole = Window.partitionBy("session_id")
    order = whole.orderBy("number")
    lines = lines.withColumns({"named": F.max(F.col("word") != "").over(whole), "fenced": _so_far(F.col("fence"), order) % 2 == 1})
    speaks = F.col("named") & ~F.col("fenced") & (F.col("word") != "")
    pause = ~F.col("named") & F.col("blank") & ~F.col("fenced")
    lines = lines.withColumns({"speaks": speaks, "pause": pause}).withColumn("turn", _so_far(F.col("speaks") | F.col("pause"), order)).filter("not pause")
    turn = Window.partitionBy("session_id", "turn")
    lines = lines.withColumn("first", F.min(F.when(F.col("speaks") | ~F.col("blank"), F.col("number"))).over(turn)).filter(F.col("number") >= F.col("first"))
    stamp = F.regexp_extract("line", rules.TIMESTAMP_IN_LINE, 0)
    named = lambda value: F.max(F.when(F.col("speaks"), F.when(value != "", value))).over(turn)
    lines = lines.withColumns({"said": named(F.lower("word")), "stamp": named(stamp)})
    return lines.filter(~F.col("speaks") | (T.trim("rest") != "")).select(
        "session_id", "turn", F.col("said").alias("word"), "stamp", "first", "number", F.when(F.col("speaks"), F.col("rest")).otherwise(F.col("line")).alias("line"))


def _text(lines: Column) -> Column:
    """Numbered lines as one text, trimmed; null if it is blank."""
    joined = T.trim(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n"))
    return F.when(joined != "", joined)


def shell_lines(turns: DataFrame) -> DataFrame:
    """Lines of turns with what they are in a shell: command (its text or null), output (number of the prompt so far), taken, ends.

    taken tells that the line belongs to the output of that prompt, ends that it ends it.
    """
    turn = Window.partitionBy("session_id", "turn").orderBy("number")
    lines = turns.withColumns({"fence": F.col("line").rlike(_FENCE), "blank": T.trim("line") == ""})
    lines = lines.withColumn("fences", _so_far(F.col("fence"), turn))
    opened = F.when(F.col("fence") & (F.col("fences") % 2 == 1), F.col("line").rlike(_SHELL_FENCE))
    lines = lines.withColumn("of_shell", F.coalesce(F.last(opened, ignorenulls=True).over(turn), F.lit(False)))
    inside = F.col("fences") % 2 == 1
    lines = lines.withColumns({"shell": ~F.col("fence") & inside & F.col("of_shell"), "free": ~F.col("fence") & ~inside})
    prompted = F.regexp_extract("line", _PROMPT, 1)
    lines = lines.withColumn("prompt", (prompted != "") & (F.col("shell") | (F.col("free") & F.col("line").rlike(_DOLLAR))))
    block = Window.partitionBy("session_id", "turn", "fences").orderBy("number")
    lines = lines.withColumns({"answers": F.col("shell") & (_so_far(F.col("prompt"), block, before=True) > 0), "output": _so_far(F.col("prompt"), turn)})
    plain = F.col("shell") & ~F.col("answers") & ~F.col("blank") & ~F.startswith(T.trim("line"), F.lit("#"))
    lines = lines.withColumns({
        "command": F.when(F.col("prompt"), T.trim(prompted)).when(plain, T.trim("line")),
        "ends": (F.col("fence") & ~inside & F.col("of_shell")) | (F.col("free") & F.col("blank"))})
    of_output = Window.partitionBy("session_id", "turn", "output").orderBy("number")
    open_ = (F.col("output") > 0) & (_so_far(F.col("ends"), of_output) == 0)
    return lines.withColumn("taken", open_ & ~F.col("prompt") & (F.col("answers") | F.col("free")))


def session_turns(sessions: DataFrame) -> DataFrame:
    """Events of plain-text transcripts (session_id, text): messages, commands and their output; ids are line numbers.

    A turn is one message; its commands and outputs follow it, an output where the line stands that ends it.
    """
    turns = turn_lines(sessions)
    who = ["session_id", "turn", "word", "stamp"]
    listed = F.collect_list(F.struct("number", "line"))
    messages = turns.groupBy(*who, "first").agg(_text(listed).alias("text")).filter("text is not null").select(
        *who, F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), F.lit("message").alias("kind"),
        F.concat(F.lit("line "), "first").alias("id"), F.substring("text", 1, rules.MAX_EVENT_TEXT).alias("text"))
    lines = shell_lines(turns)
    commands = lines.filter("command is not null").select(
        *who, F.col("number").alias("place"), F.lit(1).alias("part"), F.lit("command").alias("kind"), F.concat(F.lit("line "), "number").alias("id"), F.col("command").alias("text"))
    outputs = lines.filter("output > 0").groupBy(*who, "output").agg(
        _text(F.collect_list(F.when(F.col("taken"), F.struct("number", "line")))).alias("text"), F.min("number").alias("prompt"),
        F.coalesce(F.min(F.when(F.col("ends"), F.col("number"))), F.max("number") + 1).alias("place"))
    outputs = outputs.filter("text is not null").select(
        *who, "place", F.lit(0).alias("part"), F.lit("result").alias("kind"), F.concat(F.lit("line "), "prompt", F.lit(":output")).alias("id"), "text")
    events = messages.unionByName(commands).unionByName(outputs)
    order = Window.partitionBy("session_id").orderBy("turn", "place", "part")
    word = F.col("word")
    role = F.when(word.isin("human", "me"), "user").when(word.isin(*rules.ASSISTANT_WORDS), "assistant").otherwise(word)
    return events.select(
        "session_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "id", "kind", role.alias("role"), T.normalize_timestamp("stamp").alias("ts"), "text",
        F.when(F.col("kind") == "command", F.col("text")).alias("command"), F.lit(None).cast("string").alias("tool"))
