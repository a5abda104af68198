"""Text functions as Column expressions: trimming, Markdown stripping, sentences, wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repochron import rules

_SPACE = f"[{rules.JS_SPACE}]"
_NOT_SPACE = f"[^{rules.JS_SPACE}]"
_BREAK = "\u0001"
_BLOCK_START = r"(?:[-*+>]|\d+[.)]|#{1,6}\s|```|~~~)"


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def locale_key(text) -> Column:
    """Sort key that follows the Unicode collation instead of code points."""
    return F.collate(_column(text), "UNICODE")


def trim(text) -> Column:
    """Removes every kind of Unicode white space at both ends, not only blanks."""
    return F.regexp_replace(_column(text), rf"\A{_SPACE}+|{_SPACE}+\z", "")


def collapse(text) -> Column:
    return trim(F.regexp_replace(_column(text), f"{_SPACE}+", " "))


def unix_lines(text) -> Column:
    return F.replace(_column(text), F.lit("\r\n"), F.lit("\n"))


def truncate(text, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word boundary past 60% of the limit."""
    single = collapse(text)
    cut = F.substring(single, 1, limit - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    has_space = F.instr(cut, " ") > 0
    body = F.when(has_space & (space > limit * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    short = F.regexp_replace(body, rf"[{rules.JS_SPACE},;:.–—-]+\z", "")
    return F.when(F.length(single) <= limit, single).otherwise(F.concat(short, F.lit("…")))


def strip_markdown(text) -> Column:
    steps = [
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
        (r"<[^>]+>", ""),
        (r"(\*\*|__)(.+?)\1", "$2"),
        (rf"(^|[{rules.JS_SPACE}(])[*_]([^*_{rules.JS_SPACE}][^*_]*?)[*_](?=[{rules.JS_SPACE}).,:;!?]|\z)", "$1$2"),
    ]
    result = _column(text)
    for pattern, replacement in steps:
        result = F.regexp_replace(result, pattern, replacement)
    return collapse(result)


def unwrap_lines(text) -> Column:
    """Logical lines: hard-wrapped lines joined; lists, headings, quotes and fences start anew."""
    t = unix_lines(text)
    t = F.regexp_replace(t, rf"\n{_SPACE}*\n", _BREAK)
    t = F.regexp_replace(t, rf"\n(?={_SPACE}*{_BLOCK_START})", _BREAK)
    t = F.regexp_replace(t, rf"{_SPACE}*\n{_SPACE}*", " ")
    return F.filter(F.transform(F.split(t, _BREAK), trim), lambda line: line != "")


def sentences(text) -> Column:
    """Sentences of the unwrapped lines; inline code never splits."""
    pattern = rf"((?:`[^`]*`|[^.!?`]++|[.!?](?={_NOT_SPACE}))++[.!?]*)"

    def of_line(line: Column) -> Column:
        clean = trim(F.regexp_replace(line, rf"\A{_SPACE}*(?:[-*+>]|\d+[.)]){_SPACE}+", ""))
        parts = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
        return F.when(clean == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(clean)).otherwise(parts)

    flat = F.flatten(F.transform(unwrap_lines(text), of_line))
    return F.filter(F.transform(flat, trim), lambda s: s != "")


def without_code_fences(text) -> Column:
    t = F.regexp_replace(_column(text), r"```[\s\S]*?```", " ")
    return F.regexp_replace(t, r"~~~[\s\S]*?~~~", " ")


def spoken_sentences(text) -> Column:
    """Sentences of 30 to 400 characters outside code fences, without Markdown."""
    plain = F.transform(sentences(without_code_fences(text)), strip_markdown)
    return F.filter(plain, lambda s: F.length(s).between(30, 400))


def join_words(words) -> Column:
    w = _column(words)
    n = F.size(w)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.try_element_at(w, F.lit(1)))
        .when(n == 2, F.concat_ws(" and ", w))
        .otherwise(F.concat(F.array_join(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(w, F.lit(-1)))))


def format_count(value) -> Column:
    return F.format_number(F.round(_column(value)).cast("long"), 0)


def plural(value, singular: str, many: str | None = None) -> Column:
    v = _column(value)
    return F.concat(format_count(v), F.when(v == 1, f" {singular}").otherwise(f" {many or singular + 's'}"))


def plural_suffix(value) -> Column:
    return F.when(_column(value) == 1, "").otherwise("s")


def code_span(value) -> Column:
    single = F.regexp_replace(_column(value), rf"{_SPACE}*[\r\n]+{_SPACE}*", " ")
    return F.when(single.contains("`") | (single == ""), F.concat(F.lit("“"), single, F.lit("”"))).otherwise(
        F.concat(F.lit("`"), single, F.lit("`")))


def sanitize(value) -> Column:
    return F.regexp_replace(_column(value), rules.UNSAFE_CHARACTERS, "�")


def capitalize(value) -> Column:
    v = _column(value)
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 1 << 30))


def decision_key(sentence) -> Column:
    return F.trim(F.regexp_replace(F.lower(_column(sentence)), "[^a-z0-9]+", " "))


def requirement_name(requirement) -> Column:
    r = _column(requirement)
    name = F.regexp_extract(r, rf"\A{_SPACE}*([A-Za-z0-9_.-]+)", 1)
    return F.lower(F.when(name == "", r).otherwise(name))


# ---------------------------------------------------------------------- sentence and heading predicates
def is_statement(sentence) -> Column:
    return ~trim(sentence).rlike(r"[:?]\z")


def states_decision(sentence) -> Column:
    s = _column(sentence)
    return is_statement(s) & (s.rlike(rules.CHOICE_PHRASE) | (s.rlike(rules.COMPARISON_PHRASE) & s.rlike(rules.ACTION_WORD)))


def is_debugging_note(sentence) -> Column:
    s = _column(sentence)
    return s.rlike(rules.DEBUGGING_PHRASE) & is_statement(s)


def has_rationale(sentence) -> Column:
    s = _column(sentence)
    return s.rlike(rules.RATIONALE) & (F.length(s) >= 20)


def rationale_sentences(text) -> Column:
    """Sentences with a rationale; only texts that have its words, whatever parts them, are cut into sentences."""
    words = rules.RATIONALE.replace(r"\b", "").replace(" ", f"{_SPACE}+")
    return F.when(_column(text).rlike(words), F.filter(sentences(text), has_rationale)).otherwise(F.array().cast("array<string>"))


def is_decision_heading(title) -> Column:
    t = _column(title)
    return t.rlike(rules.DECISION_HEADING) & ~(t.rlike(r"(?i)^why\b") & t.rlike(rules.READER_QUESTION))


# ---------------------------------------------------------------------- dates
def iso_date(raw) -> Column:
    return F.substring(_column(raw), 1, 10)


def format_date(raw) -> Column:
    r = _column(raw)
    day = F.try_to_date(F.substring(r, 1, 10), "yyyy-MM-dd")
    return F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.date_format(day, "MMM d, yyyy"), r)).otherwise(r)


def inclusive_days(first_raw, last_raw) -> Column:
    first = F.try_to_date(iso_date(first_raw), "yyyy-MM-dd")
    last = F.try_to_date(iso_date(last_raw), "yyyy-MM-dd")
    return F.coalesce(F.abs(F.datediff(last, first)) + 1, F.lit(0)).cast("long")


def instant_ms(raw) -> Column:
    """Milliseconds of an ISO text; a time without a zone is UTC, whatever the session time zone is."""
    r = F.regexp_replace(_column(raw), r"([T ]\d{1,2}:\d{2})(?=[Zz+-]|\z)", "$1:00")
    zoned = F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.concat(r, F.lit("T00:00:00Z"))).when(r.rlike(r"[T ][\d:.]+\z"), F.concat(r, F.lit("Z"))).otherwise(r)
    return F.unix_millis(zoned.try_cast("timestamp"))


def iso_from_ms(ms) -> Column:
    """UTC text with milliseconds, whatever the session time zone is."""
    stamp = F.timestamp_millis(_column(ms).cast("long"))
    utc = F.to_utc_timestamp(stamp, F.expr("current_timezone()"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_timestamp(value) -> Column:
    """ISO text or epoch seconds / milliseconds as text -> ISO text in UTC with milliseconds."""
    v = trim(value)
    number = v.try_cast("double")
    ms = F.when(number < 1e12, number * 1000).otherwise(number)
    is_number = v.rlike(r"^[0-9.eE+]+\z") & (number > 0) & (number < 8.64e15)
    iso = F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    parsed = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), instant_ms(iso))
    return F.when(is_number, iso_from_ms(F.floor(ms))).otherwise(iso_from_ms(parsed))
