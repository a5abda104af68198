"""Commands found in CI configurations, and the scripts behind them.

A configuration is at most ``rules.MAX_DOCUMENT_BYTES`` long; windows lie inside one file.  Lines are
numbered, keys take spans of the lines after them by indentation, and spans inside others do not count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commands as C
from repochron.functions import paths as P
from repochron.functions import text as T

_S = f"[{rules.JS_SPACE}]"
_ANY = r"[^\n\r\u2028\u2029]*"
_USES = rf"\A{_S}*-?{_S}*uses:{_S}*[\"']?([^{rules.JS_SPACE}\"'#]+)"
_STEP = rf"\A({_S}*)(?:-{_S}+)?(run|script|before_script|after_script|commands|command):{_S}*({_ANY})\z"
_ITEM = rf"\A{_S}*-{_S}+"
_HERE_WORD = r"<<-?\s*(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\1"
_FILE = ["repo_id", "path"]


def _outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans (keys, start, end) in order of start, those that do not start inside an earlier one that counts itself.

    One bounded file at a time: a span that counts hides what starts inside it, whatever that spans.
    """
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    nothing = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<bigint>").alias("found"))

    def add(acc, x):
        return F.when(x["start"] > acc["reach"], F.struct(x["end"].alias("reach"), F.array_append(acc["found"], x["start"]).alias("found"))).otherwise(acc)

    found = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return found.select(*keys, F.explode(F.aggregate("spans", nothing, add, lambda acc: acc["found"])).alias("start"))


def numbered_lines(configurations: DataFrame) -> DataFrame:
    """(repo_id, path, number, line, indent, blank, item) and what a line is as a key: kind, key, value.

    kind is action, block (a scalar on the following lines), list, flow (in brackets), inline or null.
    """
    lines = configurations.select(*_FILE, F.posexplode(F.split(T.unix_lines("text"), "\n", -1)).alias("i", "line"))
    part = lambda group: F.regexp_extract("line", _STEP, group)
    uses, value = F.regexp_extract("line", _USES, 1), T.trim(F.regexp_replace(part(3), rf"{_S}+#{_ANY}\z", ""))
    rows = lines.select(
        *_FILE, (F.col("i") + 1).cast("long").alias("number"), "line", F.length(F.regexp_extract("line", rf"\A{_S}*", 0)).alias("indent"), (T.trim("line") == "").alias("blank"),
        F.col("line").rlike(_ITEM).alias("item"), F.length(part(1)).alias("depth"), part(2).alias("key"), uses.alias("uses"), value.alias("value"))
    kind = F.when(F.col("uses") != "", "action").when(F.col("key") == "", None).when(F.col("value").rlike(r"\A[|>][-+]?[0-9]*\z"), "block").when(F.col("value") == "", "list").when(
        F.startswith("value", F.lit("[")), "flow").when(F.col("key") != "commands", "inline")
    return rows.withColumn("kind", kind)


def key_spans(lines: DataFrame) -> DataFrame:
    """(repo_id, path, start, end, kind, value, uses): the keys of a file, each with the lines it takes.

    A block takes the lines that are blank or indented deeper than its key, a list the items that
    are indented as deep at least.  A key inside lines that another key takes is none.
    """
    opening = lines.filter("kind in ('block', 'list')")
    depths = opening.select(*_FILE, "kind", "depth").distinct()
    stops = F.when(F.col("kind") == "block", ~F.col("blank") & (F.col("indent") <= F.col("depth"))).otherwise(~(F.col("item") & (F.col("indent") >= F.col("depth"))))
    after = Window.partitionBy(*_FILE, "kind", "depth").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    seen = lines.select(*_FILE, "number", "indent", "blank", "item").join(depths, _FILE)
    reach = seen.withColumn("stop", F.coalesce(F.min(F.when(stops, F.col("number"))).over(after), F.lit(1 << 40))).select(*_FILE, "kind", "depth", "number", "stop")
    last = lines.groupBy(*_FILE).agg(F.max("number").alias("last"))
    taken = opening.join(reach, [*_FILE, "kind", "depth", "number"]).join(last, _FILE).withColumn("end", F.least(F.col("stop") - 1, F.col("last")))
    columns = [*_FILE, F.col("number").alias("start"), "end", "kind", "value", "uses"]
    keys = taken.select(columns).union(lines.filter("kind in ('action', 'flow', 'inline')").withColumn("end", F.col("number")).select(columns))
    return keys.join(_outermost(keys, _FILE), [*_FILE, "start"], "left_semi")


def _block_commands(inner: DataFrame) -> DataFrame:
    """Commands of block scalars: here-document bodies are left out, continued lines joined."""
    block = [*_FILE, "start"]
    opened = inner.select(*block, "number", "end", F.regexp_extract("line", _HERE_WORD, 2).alias("word")).filter("word <> ''")
    closing = inner.select(*block, F.col("number").alias("close"), T.trim("line").alias("word"))
    bodies = opened.join(closing, [*block, "word"], "left").groupBy(*block, "number", "end").agg(F.min(F.when(F.col("close") > F.col("number"), F.col("close"))).alias("close"))
    bodies = bodies.select(*block, "number", F.coalesce("close", "end").alias("close"))
    counted = _outermost(bodies.select(*_FILE, F.col("start").alias("block"), F.col("number").alias("start"), F.col("close").alias("end")), [*_FILE, "block"])
    counted = counted.select(*_FILE, F.col("block").alias("start"), F.col("start").alias("number"))
    data = bodies.join(counted, [*block, "number"], "left_semi").filter("close > number").select(*block, F.explode(F.sequence(F.col("number") + 1, F.col("close"))).alias("number"), F.lit(True).alias("data"))
    lines = inner.join(data, [*block, "number"], "left").withColumn("text", F.when(F.col("data"), "").otherwise(T.trim("line")))
    goes_on = F.endswith("text", F.lit("\\"))
    before = Window.partitionBy(*block).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("group", F.coalesce(F.sum((~goes_on).cast("int")).over(before), F.lit(0)))
    part = T.trim(F.regexp_replace("text", r"\\\z", ""))
    groups = lines.groupBy(*block, "group").agg(F.min("number").alias("line"), F.array_sort(F.collect_list(F.struct("number", part.alias("part")))).alias("parts"))
    words = F.filter(F.transform("parts", lambda x: x["part"]), lambda x: x != "")
    return groups.select(*block, "line", F.lit(0).alias("i"), F.array_join(words, " ").alias("value"))


def ci_entries(documents: DataFrame) -> DataFrame:
    """(repo_id, path, pos, entry, line, value): commands and reusable actions of CI configurations, in file order."""
    configurations = documents.select("repo_id", "path", "text").filter(P.ci_system("path").isNotNull())
    lines = numbered_lines(configurations)
    keys = key_spans(lines)
    out = [*_FILE, "start", "line", "i", "value"]
    taken = keys.filter("kind in ('block', 'list') and end > start").select(*_FILE, "start", "end", "kind", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("number"))
    inner = taken.join(lines.select(*_FILE, "number", "line"), [*_FILE, "number"])
    items = inner.filter("kind = 'list'").select(*_FILE, "start", F.col("number").alias("line"), F.lit(0).alias("i"), F.regexp_replace("line", _ITEM, "").alias("value"))
    close = F.instr(F.reverse("value"), "]")
    listed = F.substring("value", F.lit(2), F.greatest(F.lit(0), F.length("value") - F.greatest(close, F.lit(1)) - 1))
    flow = keys.filter("kind = 'flow'").select(*_FILE, "start", F.col("start").alias("line"), F.posexplode(F.split(listed, ",", -1)).alias("i", "value"))
    inline = keys.filter("kind = 'inline'").select(*_FILE, "start", F.col("start").alias("line"), F.lit(0).alias("i"), "value")
    commands = reduce(DataFrame.union, [df.select(out) for df in (items, _block_commands(inner.filter("kind = 'block'")), flow, inline)])
    plain = T.trim("value")
    commands = commands.withColumn("value", plain).withColumn("value", F.regexp_replace("value", r"(?s)\A([\"'])(.*)\1\z", "$2")).filter("value <> '' and not startswith(value, '#')")
    actions = keys.filter("kind = 'action'").select(*_FILE, "start", F.col("start").alias("line"), F.lit(0).alias("i"), F.col("uses").alias("value"))
    rows = commands.withColumn("entry", F.lit("command")).union(actions.withColumn("entry", F.lit("action")))
    order = Window.partitionBy(*_FILE).orderBy("start", "line", "i")
    return rows.select(*_FILE, (F.row_number().over(order) - 1).cast("long").alias("pos"), "entry", "line", "value")


def root_scripts(manifests: DataFrame) -> DataFrame:
    """Scripts of each repository's root manifest (``manifests`` carry ``is_root``)."""
    return manifests.filter("is_root").select("repo_id", "scripts")


def with_purposes(commands: DataFrame) -> DataFrame:
    """``command`` and ``scripts`` -> purposes, the script run directly, the scripts reached.

    The expanded text is computed once per row in its own projection; the purpose patterns
    then look at a plain column.
    """
    scripts = F.coalesce("scripts", C.no_scripts())
    named = commands.withColumn("scripts", scripts).withColumn("_text", C.expanded_text("command", F.col("scripts")))
    name = C.script_name("command")
    resolved = F.try_element_at("scripts", name)
    return named.withColumns({
        "purposes": C.purposes_of_text("_text"),
        "script_name": F.when(resolved.isNotNull(), name), "script_command": resolved}).drop("_text")


def ci_steps(documents: DataFrame, scripts: DataFrame) -> DataFrame:
    """(repo_id, path, system, pos, line, command, purposes, script_name, script_command)."""
    commands = ci_entries(documents).filter("entry = 'command'").withColumnRenamed("value", "command")
    joined = commands.join(scripts, "repo_id", "left")
    return with_purposes(joined).select(
        "repo_id", "path", P.ci_system("path").alias("system"), "pos", "line", "command", "purposes", "script_name", "script_command")


def ci_actions(documents: DataFrame) -> DataFrame:
    return ci_entries(documents).filter("entry = 'action'").select("repo_id", "path", "line", F.col("value").alias("action"))


def ci_configurations(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per CI configuration, with the number of purposeful commands."""
    counts = steps.groupBy("repo_id", "path").agg(F.count_if(F.size("purposes") > 0).alias("purposeful"), F.count(F.lit(1)).alias("commands"))
    all_files = documents.select("repo_id", "path", P.ci_system("path").alias("system")).filter("system is not null")
    return all_files.join(counts, ["repo_id", "path"], "left").fillna(0, ["purposeful", "commands"])


def distinct_commands(steps: DataFrame) -> DataFrame:
    """First occurrence of each command text per configuration (a document of at most 256 KB)."""
    first = Window.partitionBy("repo_id", "path", "command").orderBy("pos")
    return steps.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def resolve_scripts(commands: DataFrame) -> DataFrame:
    """(.., command, script_name, script_command, step) for every script a command reaches."""
    scripts = F.coalesce("scripts", C.no_scripts())
    prepared = commands.withColumn("scripts", scripts)
    reached = prepared.select("repo_id", "command", "scripts", F.posexplode(C.reached_scripts("command", F.col("scripts"))).alias("step", "script_name"))
    return reached.select("repo_id", "command", "script_name", F.element_at("scripts", F.col("script_name")).alias("script_command"),
                          (F.col("step") + 1).cast("long").alias("step"))
