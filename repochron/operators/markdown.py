"""Markdown structure of whole documents, row by row inside the JVM (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T

_HEADING = r"\A\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*\z"
# A fenced block up to the next fence of the same character (or the end), else one line.
# Possessive repeats keep the match iterative, so document size never deepens the stack.
_CHUNK = (
    r"(?:[ \t]{0,3}```[^\n]*\n(?:(?![ \t]{0,3}```)[^\n]*\n)*+(?:[^\n]*\n)?)"
    r"|(?:[ \t]{0,3}~~~[^\n]*\n(?:(?![ \t]{0,3}~~~)[^\n]*\n)*+(?:[^\n]*\n)?)"
    r"|[^\n]*\n")


def section_array(text) -> Column:
    """array<struct<level, title, line, body>>: ATX sections, headings in fences ignored."""
    whole = F.concat(T.unix_lines(text), F.lit("\n"))
    chunks = F.regexp_extract_all(whole, F.lit(_CHUNK), F.lit(0))

    def lines_of(chunk: Column) -> Column:
        lines = F.split(F.regexp_replace(chunk, r"\n\z", ""), "\n", -1)
        single = F.size(lines) == 1
        return F.transform(lines, lambda s: F.struct(s.alias("s"), (single & s.rlike(_HEADING)).alias("h")))

    lines = F.flatten(F.transform(chunks, lines_of))

    def cut(all_lines: Column) -> Column:
        heads = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(all_lines)), lambda i: F.element_at(all_lines, i)["h"]))
        ends = F.array_append(F.slice(heads, F.lit(2), F.size(heads)), F.size(all_lines) + 1)

        def section(start: Column, end: Column) -> Column:
            head = F.when(start > 0, F.element_at(all_lines, F.greatest(start, F.lit(1)))["s"])
            body = F.slice(all_lines, start + 1, F.greatest(end - start - 1, F.lit(0)))
            return F.struct(
                F.coalesce(F.length(F.regexp_extract(head, _HEADING, 1)), F.lit(0)).cast("long").alias("level"),
                F.coalesce(T.strip_markdown(F.regexp_extract(head, _HEADING, 2)), F.lit("")).alias("title"),
                start.cast("long").alias("line"),
                T.trim(F.array_join(F.transform(body, lambda s: s["s"]), "\n")).alias("body"))

        return F.filter(F.zip_with(heads, ends, section), lambda s: (s["level"] > 0) | (s["body"] != ""))

    # Binding the lines once keeps them from being recomputed for every section.
    return F.element_at(F.transform(F.array(lines), cut), 1)


def with_sections(documents: DataFrame) -> DataFrame:
    return documents.withColumn("sections", section_array("text"))


def markdown_sections(documents: DataFrame) -> DataFrame:
    return with_sections(documents).select("repo_id", "path", F.posexplode("sections").alias("pos", "s")).select(
        "repo_id", "path", F.col("pos").cast("long").alias("pos"), "s.level", "s.title", "s.line", "s.body")


def first_paragraph(body) -> Column:
    """The first prose paragraph of at least 12 characters: no badges, HTML, tables, lists or code."""
    blocks = F.split(F.col(body) if isinstance(body, str) else body, r"\n\s*\n", -1)
    start = F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("found"))

    def step(state: Column, block: Column) -> Column:
        text = T.trim(block)
        fences = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(```|~~~)"), F.lit(1)))
        skipped = (text == "") | text.rlike(r"^(#|<|!\[|\[!\[|\||>\s*\[!|---|===|\*\*\*)") | text.rlike(r"^\s*([-*+]|\d+\.)\s")
        prose = T.strip_markdown(F.regexp_replace(text, r"\s*\n\s*", " "))
        inside = state["fence"] | (fences > 0)
        flipped = F.when(inside & (fences % 2 == 1), ~state["fence"]).otherwise(state["fence"])
        found = F.when(inside | skipped | (F.length(prose) < 12), F.lit(None)).otherwise(prose)
        return F.when(state["found"].isNotNull(), state).otherwise(F.struct(flipped.alias("fence"), found.cast("string").alias("found")))

    return F.aggregate(blocks, start, step, lambda state: state["found"])


def list_items(body, first_line) -> Column:
    """array<struct<raw, line>>: top-level list items with their continuation lines."""
    lines = F.split(T.unix_lines(body), "\n", -1)
    numbered = F.transform(lines, lambda s, i: F.struct(s.alias("s"), (first_line + i).cast("long").alias("line")))
    kind = "array<struct<raw:string,line:bigint>>"
    start = F.struct(F.lit(False).alias("fence"), F.lit(False).alias("open"), F.array().cast(kind).alias("items"))

    def step(state: Column, row: Column) -> Column:
        s, items = row["s"], state["items"]
        fence = state["fence"] != s.rlike(r"^\s*(```|~~~)")
        bullet = s.rlike(r"^([-*+]|\d+[.)])\s+")
        continued = state["open"] & s.rlike(r"^\s+\S") & ~s.rlike(r"^\s+([-*+]|\d+[.)])\s")
        closed = (T.trim(s) == "") | s.rlike(r"^\S")
        last = F.try_element_at(items, F.lit(-1))
        longer = F.array_append(
            F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))),
            F.struct(F.concat(last["raw"], F.lit(" "), T.trim(s)).alias("raw"), last["line"].alias("line")))
        added = F.array_append(items, F.struct(F.regexp_extract(s, r"^(?:[-*+]|\d+[.)])\s+(.*)\z", 1).alias("raw"), row["line"].alias("line")))
        result = F.when(fence, items).when(bullet, added).when(continued, longer).otherwise(items)
        is_open = F.when(fence, state["open"]).when(bullet, True).when(continued, True).when(closed, False).otherwise(state["open"])
        return F.struct(fence.alias("fence"), is_open.alias("open"), result.alias("items"))

    # Most sections hold no list at all: one search spares them the fold over their lines.
    has_bullet = (F.col(body) if isinstance(body, str) else body).rlike(r"(?m)^([-*+]|\d+[.)])\s")
    return F.when(has_bullet, F.aggregate(numbered, start, step, lambda state: state["items"])).otherwise(F.array().cast(kind))


def item_fields(raw: Column) -> tuple[Column, Column]:
    """(text, bold lead or null) of a list item."""
    bold = F.coalesce(
        F.when(raw.rlike(r"^\*\*.+?\*\*"), F.regexp_extract(raw, r"^\*\*(.+?)\*\*", 1)),
        F.when(raw.rlike(r"^__.+?__"), F.regexp_extract(raw, r"^__(.+?)__", 1)))
    return T.strip_markdown(raw), F.regexp_replace(T.strip_markdown(bold), r"[.:]\s*\z", "")


def section_items(sections: DataFrame) -> DataFrame:
    """Rows per list item of every section."""
    items = sections.select("repo_id", "path", F.col("pos").alias("section_pos"), F.posexplode(list_items("body", F.col("line") + 1)).alias("item_pos", "i"))
    text, lead = item_fields(F.col("i.raw"))
    return items.select("repo_id", "path", "section_pos", F.col("item_pos").cast("long").alias("item_pos"), text.alias("text"), lead.alias("lead"), "i.line")


def section_paragraph_and_items(sections: DataFrame) -> DataFrame:
    """The first paragraph of each section (item_pos -1) and its list items, in one pass."""
    paragraph = F.when(F.col("body") != "", first_paragraph("body"))
    parts = sections.select(
        "repo_id", "path", F.col("pos").alias("section_pos"), "line", paragraph.alias("paragraph"), list_items("body", F.col("line") + 1).alias("items"))
    lead_type = F.lit(None).cast("string")
    first = F.when(F.col("paragraph").isNotNull(), F.struct(F.lit(-1).cast("long").alias("item_pos"), F.col("paragraph").alias("text"), lead_type.alias("lead"), F.col("line").alias("line")))

    def item(i: Column, n: Column) -> Column:
        text, lead = item_fields(i["raw"])
        return F.struct(n.cast("long").alias("item_pos"), text.alias("text"), lead.alias("lead"), i["line"].alias("line"))

    rows = F.concat(F.array_compact(F.array(first)), F.transform("items", item))
    return parts.select("repo_id", "path", "section_pos", F.explode(rows).alias("r")).select("repo_id", "path", "section_pos", "r.*")
