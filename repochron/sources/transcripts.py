"""Transcripts to normalized session events: JSON lines and JSON containers; plain text is in ``text_transcripts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T
from repochron.sources.text_transcripts import session_turns

# ---------------------------------------------------------------------- JSON shapes


def at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_record(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _values(v: Column, keys) -> Column:
    return F.array(*[at(v, k) for k in keys])


def first_string(v: Column, keys) -> Column:
    strings = F.transform(F.filter(_values(v, keys), lambda x: _is(x, "STRING")), lambda x: T.trim(_text(x)))
    return F.try_element_at(F.filter(strings, lambda s: s != ""), F.lit(1))


def first_value(v: Column, keys) -> Column:
    def usable(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return (kind != "VOID") & ((kind != "STRING") | (_text(x) != ""))

    return F.try_element_at(F.filter(_values(v, keys), usable), F.lit(1))


def _nesting(v: Column) -> Column:
    """How many lists and objects lie inside each other: the highest running count of open brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(v), r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def count(state: Column, bracket: Column) -> Column:
        now = state["open"] + F.when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("open"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, count, lambda state: state["most"])


def text_of(v: Column) -> Column:
    """Text of a string, number, boolean, typed object, or a list of those, at any depth.

    Lists open into their items and objects into their text (else content), one level a step and in
    order, for as many steps as the value has levels; the texts that are left are joined by lines.
    """
    def opened(x: Column) -> Column:
        inner = F.coalesce(_present(at(x, "text")), _present(at(x, "content")))
        return F.when(_is_record(x), F.array(inner)).otherwise(F.coalesce(_as_array(x), F.array(x)))

    def scalar(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.when(T.trim(_text(x)) != "", _text(x))).when(kind.rlike("^(BIGINT|DOUBLE|BOOLEAN|DECIMAL|FLOAT)"), _text(x))

    nested = _is_record(v) | _as_array(v).isNotNull()
    leaves = F.aggregate(F.sequence(F.lit(1), _nesting(v)), F.array(v), lambda nodes, _: F.flatten(F.transform(nodes, opened)))
    texts = F.array_compact(F.transform(leaves, scalar))
    return F.when(nested, F.when(F.size(texts) > 0, F.array_join(texts, "\n"))).otherwise(scalar(v))


def _present(v: Column) -> Column:
    return F.when(~_is(v, "VOID"), v)


def clip(text: Column) -> Column:
    limit = rules.MAX_EVENT_TEXT
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


# ---------------------------------------------------------------------- entries of structured transcripts
def scan_session_jsonl(sessions: DataFrame) -> DataFrame:
    """One row per parsed line: session_id, pos (line number), position, entry."""
    lines = sessions.select("session_id", F.posexplode(F.split(T.unix_lines("text"), "\n", -1)).alias("i", "line"))
    filled = lines.filter(T.trim("line") != "")
    return filled.select("session_id", (F.col("i") + 1).cast("long").alias("pos"), F.concat(F.lit("line "), F.col("i") + 1).alias("position"),
                         F.try_parse_json("line").alias("entry"))


def jsonl_warnings(scanned: DataFrame) -> DataFrame:
    """One warning per session with unreadable lines, naming the first five; error if none is readable."""
    bad = F.col("entry").isNull()
    rows = scanned.groupBy("session_id").agg(
        F.count_if(bad).alias("n"), F.count_if(~bad).alias("good"))
    listed = scanned.filter(bad).select("session_id", "pos")
    from repochron.operators.ranking import first_rows

    first = first_rows(listed, ["session_id"], [F.col("pos")], 5).groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ", ").alias("shown"))
    many = F.col("n") > 1
    text = F.concat(F.lit("Skipped "), F.col("n"), F.when(many, " lines that are").otherwise(" line that is"), F.lit(" not valid JSON (line"),
                    F.when(many, "s ").otherwise(" "), F.col("shown"), F.when(F.col("n") > 5, ", …").otherwise(""), F.lit(")."))
    return rows.filter("n > 0").join(first, "session_id").select("session_id", text.alias("warning"), (F.col("good") == 0).alias("is_error"))


def scan_session_json(sessions: DataFrame) -> DataFrame:
    """Entries of a JSON transcript: the top array, the first container list that holds any, or the object itself.

    A list right below an object is taken even if empty; of objects among its keys the first whose own
    search finds an entry counts.  Objects are searched to the depth the rules set.
    """
    def found(v: Column, depth: int) -> Column:
        held = F.filter(_values(v, rules.CONTAINER_KEYS), lambda c: _as_array(c).isNotNull() | _is_record(c))
        below = (lambda c: found(c, depth + 1)) if depth < rules.CONTAINER_DEPTH else (lambda c: F.array().cast("array<variant>"))
        searched = F.transform(held, lambda c: F.struct(_as_array(c).isNotNull().alias("is_list"), F.coalesce(_as_array(c), below(c)).alias("entries")))
        return F.coalesce(F.try_element_at(F.filter(searched, lambda s: s["is_list"] | (F.size(s["entries"]) > 0)), F.lit(1))["entries"], F.array(v))

    rows = sessions.select("session_id", F.try_parse_json("text").alias("v")).filter("v is not null")
    entries = F.coalesce(_as_array(F.col("v")), F.when(_is_record(F.col("v")), found(F.col("v"), 0)))
    return rows.select("session_id", F.posexplode(entries).alias("i", "entry")).select(
        "session_id", (F.col("i") + 1).cast("long").alias("pos"), F.concat(F.lit("entry "), F.col("i") + 1).alias("position"), "entry")


#: more parts than an array can have, so no two events of a session share a position
PARTS = 1 << 32
_EVENT = "struct<kind:string,suffix:string,text:string,command:string,tool:string>"


def _event(kind, suffix, text, command=None, tool=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).alias("kind"), lit(suffix).alias("suffix"), lit(text).alias("text"), lit(command).cast("string").alias("command"),
                    lit(tool).cast("string").alias("tool")).cast(_EVENT)


def _parts(content: Column) -> Column:
    """Events of typed content parts; plain text parts have kind "text"."""
    def part(p: Column, i: Column) -> Column:
        kind = first_string(p, ["type"])
        call = F.coalesce(F.when(_is_record(at(p, "input")), at(p, "input")), F.when(_is_record(at(p, "arguments")), at(p, "arguments")))
        tool = F.coalesce(first_string(p, ["name"]), F.lit("tool"))
        command = first_string(call, ["command", "cmd"])
        suffix = F.concat(F.lit("part"), i)
        result = text_of(F.coalesce(_present(at(p, "content")), _present(at(p, "output"))))
        words = text_of(F.coalesce(_present(at(p, "text")), _present(at(p, "content"))))
        none = F.lit(None).cast(_EVENT)
        kind = F.coalesce(kind, F.lit(""))
        return (
            F.when(_is(p, "STRING"), _event("text", suffix, _text(p)))
            .when(~_is_record(p) | kind.isin("thinking", "redacted_thinking", "reasoning"), none)
            .when(kind.isin("tool_use", "tool_call", "function_call"), F.when(
                command.isNotNull(), _event("command", suffix, command, command, tool)).otherwise(
                _event("tool", suffix, F.coalesce(F.to_json(call), tool), None, tool)))
            .when(kind.isin("tool_result", "function_call_output"), F.when(result.isNotNull(), _event("result", suffix, result)))
            .when(words.isNotNull(), _event("text", suffix, words)))

    return F.array_compact(F.transform(_as_array(content), part))


def session_entries(entries: DataFrame) -> DataFrame:
    """Normalized events of structured entries (session_id, pos, position, entry)."""
    e = F.col("entry")
    nested = F.when(_is_record(at(e, "message")), at(e, "message"))
    author = at(e, "author")
    typed = first_string(e, ["type"])
    role = F.lower(F.coalesce(
        first_string(e, rules.ROLE_KEYS),
        F.when(_is_record(author), first_string(author, ["role", "name"])).when(_is(author, "STRING"), _text(author)),
        first_string(nested, rules.ROLE_KEYS), F.when(F.lower(typed).isin(*rules.KNOWN_ROLES), typed)))
    time = F.coalesce(first_value(e, rules.TIME_KEYS), first_value(nested, rules.TIME_KEYS))
    is_text = _is(time, "STRING")
    stamp = F.when(~is_text | _text(time).rlike(r"^\s*\d{4}-\d{2}-\d{2}"), T.normalize_timestamp(_text(time)))
    rows = entries.select(
        "session_id", "pos", "entry", nested.alias("nested"), F.coalesce(first_string(e, rules.ID_KEYS), first_string(nested, rules.ID_KEYS), F.col("position")).alias("base"),
        F.when(role == "human", "user").when(role.isin("ai", "model"), "assistant").otherwise(F.substring(role, 1, 40)).alias("role"), stamp.alias("ts"))

    call = F.when(_is_record(at(e, "input")), at(e, "input"))
    command = F.coalesce(first_string(e, ["command", "cmd"]), first_string(call, ["command", "cmd"]))
    is_call = F.coalesce(first_string(e, ["type"]).isin("tool_use", "tool_call"), F.lit(False))
    tool = F.coalesce(first_string(e, ["tool", "tool_name", "toolName"]), F.when(is_call, first_string(e, ["name"])))
    own = F.when(command.isNotNull(), _event("command", "", command, command, tool)).when(
        tool.isNotNull(), _event("tool", "", F.coalesce(F.to_json(call), tool), None, tool))
    nested_col = F.col("nested")
    without_message = [k for k in rules.CONTENT_KEYS if k != "message"]
    content = F.coalesce(F.when(nested_col.isNull(), first_value(e, rules.CONTENT_KEYS)).otherwise(first_value(e, without_message)), first_value(nested_col, rules.CONTENT_KEYS))
    rows = rows.withColumns({"own": F.array_compact(F.array(own)), "content": content})

    c = F.col("content")
    rows = rows.withColumns({
        "parts": F.when(_as_array(c).isNotNull(), _parts(c)),
        "plain": F.when(_as_array(c).isNull(), text_of(c))})
    exit_code = F.coalesce(_present(at(e, "exit_code")), _present(at(e, "exitCode")))
    code = F.when(F.schema_of_variant(exit_code).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.concat(F.lit("\n(exit code "), _text(exit_code), F.lit(")"))).otherwise("")
    rows = rows.withColumns({f"_{k}": text_of(at(e, k)) for k in rules.OUTPUT_KEYS}).withColumn("_code", code)
    outputs = F.array_compact(F.array(*[F.when(F.col(f"_{k}").isNotNull(), _event("result", k, F.concat(f"_{k}", "_code"))) for k in rules.OUTPUT_KEYS]))
    rows = rows.withColumn("outputs", outputs)

    texts = F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["text"])
    joined = F.coalesce(F.col("plain"), F.when(T.trim(F.array_join(texts, "\n")) != "", T.trim(F.array_join(texts, "\n"))))
    suffix = F.when(F.size("own") == 0, "").otherwise("content")
    message = F.array_compact(F.array(F.when(joined.isNotNull(), _event("message", suffix, joined))))
    others = F.coalesce(F.filter("parts", lambda p: p["kind"] != "text"), F.array().cast(f"array<{_EVENT}>"))
    rows = rows.withColumn("earlier", F.concat("own", message, others))
    placed = F.transform("outputs", lambda o, i: F.when((F.size("earlier") == 0) & (i == 0), _event("result", "", o["text"])).otherwise(o))
    whole = F.when(_is(e, "STRING"), F.when(T.trim(_text(e)) != "", F.array(_event("message", "", _text(e))))).otherwise(F.concat("earlier", placed))
    events = rows.select("session_id", "pos", "base", "role", "ts", F.posexplode(whole).alias("sub", "v"))
    return events.select(
        "session_id", (F.col("pos") * PARTS + F.col("sub")).alias("pos"),
        F.when(F.col("v.suffix") == "", F.col("base")).otherwise(F.concat("base", F.lit(":"), F.col("v.suffix"))).alias("id"),
        "v.kind", "role", "ts", clip(F.col("v.text")).alias("text"), clip(F.col("v.command")).alias("command"), "v.tool")


def parse_sessions(sessions: DataFrame) -> DataFrame:
    """Events of accepted transcript files of all three formats."""
    of = lambda kind: sessions.filter((F.col("format") == kind) & F.col("text").isNotNull())
    lines = scan_session_jsonl(of("jsonl")).filter("entry is not null")
    structured = session_entries(scan_session_json(of("json")).unionByName(lines))
    return structured.unionByName(session_turns(of("text")))
