"""Evidence drafts, their numbering, and the references from statements to them.

Operators attach an array of drafts to every row they produce.  Drafts are exploded,
identical ones collapse, and the survivors of a repository are numbered in the order they
were first recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.operators import ranking

_SOURCE_FIELDS = [
    ("kind", "string"), ("sha", "string"), ("short_sha", "string"), ("date", "string"), ("files", "array<string>"),
    ("first_sha", "string"), ("last_sha", "string"), ("count", "bigint"), ("commits", "array<string>"),
    ("path", "string"), ("section", "string"), ("line", "bigint"), ("excerpt", "string"),
    ("description", "string"), ("total", "bigint"), ("paths", "array<string>"), ("name", "string"),
    ("file", "string"), ("event_id", "string"), ("timestamp", "string"), ("role", "string"),
]
SOURCE_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in _SOURCE_FIELDS) + ">"
DRAFT_TYPE = f"struct<level:string,category:string,statement:string,basis:string,source:{SOURCE_TYPE}>"
DRAFTS_TYPE = f"array<{DRAFT_TYPE}>"


def draft(level: str | Column, category: str | Column, statement: Column, *, basis: Column | None = None, **source) -> Column:
    """One evidence draft; ``source`` holds the fields of its source, absent ones are null."""

    def value(name: str, kind: str) -> Column:
        given = source.get(name)
        column = given if isinstance(given, Column) else F.lit(given)
        return column.cast(kind).alias(name)

    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(level).alias("level"), lit(category).alias("category"), statement.cast("string").alias("statement"),
        (F.lit(None) if basis is None else basis).cast("string").alias("basis"),
        F.struct(*[value(n, t) for n, t in _SOURCE_FIELDS]).alias("source"))


def drafts(*columns: Column) -> Column:
    """The non-null drafts as an array."""
    return F.array_compact(F.array(*columns)).cast(DRAFTS_TYPE)


def key_of(draft_column: Column) -> Column:
    return F.sha2(F.to_json(draft_column), 256)


def explode_drafts(items: DataFrame, order: str) -> DataFrame:
    """(repo_id, ord, key, draft) in recording order; ``order`` is a dense-enough BIGINT per item."""
    return items.select("repo_id", order, F.posexplode("drafts").alias("sub", "draft")).select(
        "repo_id", (F.col(order) * 64 + F.col("sub")).alias("ord"), key_of(F.col("draft")).alias("key"), "draft")


def number_evidence(exploded: DataFrame) -> DataFrame:
    """Identical drafts once, numbered E1..En by first occurrence (first-insertion order)."""
    distinct = exploded.groupBy("repo_id", "key").agg(F.min("ord").alias("ord"), F.first("draft").alias("draft"))
    numbered = ranking.number_rows_by_key(distinct, ["repo_id"], "ord", "n")
    return numbered.select("repo_id", F.concat(F.lit("E"), F.col("n")).alias("id"), "n", "ord", "key", "draft.*")


def references(exploded: DataFrame, numbered: DataFrame) -> DataFrame:
    """(repo_id, ord, key, id) for every use of a draft."""
    return exploded.select("repo_id", "ord", "key").join(numbered.select("repo_id", "key", "id"), ["repo_id", "key"])


def integrity(refs: DataFrame, numbered: DataFrame) -> DataFrame:
    """References without evidence and evidence without references; empty when all is well."""
    unresolved = refs.join(numbered, ["repo_id", "key"], "left_anti").select("repo_id", "key", F.lit("unresolved").alias("problem"))
    unused = numbered.join(refs, ["repo_id", "key"], "left_anti").select("repo_id", "key", F.lit("unreferenced").alias("problem"))
    return unresolved.unionByName(unused)


def describe_source(source: Column) -> Column:
    """One line that points a reader at the source."""
    from repochron.functions.text import code_span

    s = lambda field: source.getField(field)
    spans = lambda values, n: F.array_join(F.transform(F.slice(values, 1, n), code_span), ", ")
    files = s("files")
    more_files = F.when(F.size(files) > 3, F.concat(F.lit(" and "), F.size(files) - 3, F.lit(" more"))).otherwise("")
    commit = F.concat(
        F.lit("Commit "), code_span(s("short_sha")), F.lit(" ("), s("date"), F.lit(")"),
        F.when(F.coalesce(F.size(files), F.lit(0)) > 0, F.concat(F.lit("; "), spans(files, 3), more_files)).otherwise(""))
    first = code_span(F.substring(s("first_sha"), 1, 7))
    commit_range = F.when(s("count") == 1, F.concat(F.lit("Commit "), first)).otherwise(
        F.concat(s("count"), F.lit(" commits, "), first, F.lit(" to "), code_span(F.substring(s("last_sha"), 1, 7))))
    where = F.concat_ws(", ", F.when(s("line") > 0, F.concat(F.lit("line "), s("line"))), F.concat(F.lit("“"), s("section"), F.lit("”")))
    file = F.concat(code_span(s("path")), F.when(where != "", F.concat(F.lit(", "), where)).otherwise(""))
    shown = F.least(F.lit(4), F.size(s("paths")))
    file_set = F.concat(
        s("description"),
        F.when(shown > 0, F.concat(
            F.lit(": "), spans(s("paths"), 4),
            F.when(s("total") > shown, F.concat(F.lit(", and "), s("total") - shown, F.lit(" more"))).otherwise(""))).otherwise(""))
    tag = F.concat(F.lit("Tag "), code_span(s("name")), F.lit(" at "), code_span(F.substring(s("sha"), 1, 7)))
    moment = F.concat(F.substring(F.replace(s("timestamp"), F.lit("T"), F.lit(" ")), 1, 16), F.lit(" UTC"))
    details = F.concat_ws(", ", s("role"), moment)
    session = F.concat(F.lit("Session "), code_span(s("file")), F.lit(", "), s("event_id"),
                       F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""))
    kind = s("kind")
    return (
        F.when(kind == "commit", commit).when(kind == "commit-range", commit_range).when(kind == "file", file)
        .when(kind == "file-set", file_set).when(kind == "tag", tag).when(kind == "session", session))


def appendix(numbered: DataFrame) -> DataFrame:
    source = F.col("source")
    excerpt = F.when(source["kind"].isin("file", "session"), source["excerpt"])
    return numbered.select(
        "repo_id", "id", "level", "statement", describe_source(source).alias("source"),
        F.when(F.length(excerpt) > 200, F.concat(F.substring(excerpt, 1, 199), F.lit("…"))).otherwise(excerpt).alias("excerpt"),
        "basis")
