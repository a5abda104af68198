"""Path predicates as Column expressions; only names are looked at, never contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repochron import rules


def _column(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def any_match(column: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(p) for p in patterns])


def base_name(path) -> Column:
    return F.substring_index(_column(path), "/", -1)


def directory(path) -> Column:
    p = _column(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise("")


def depth(path) -> Column:
    return F.length(_column(path)) - F.length(F.replace(_column(path), F.lit("/"), F.lit("")))


def extension(path) -> Column:
    """With its dot; empty for dotfiles and names without one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)\z", 1)


def is_documentation(path) -> Column:
    p, name = _column(path), base_name(path)
    return (
        F.when(name.rlike(rules.DOC_NAME), True)
        .when(name.rlike(rules.LICENSE_NAME), False)
        .when(p.rlike(rules.DOC_DIRECTORY), p.rlike(rules.DOC_EXTENSION_IN_DOCS))
        .otherwise(p.rlike(rules.DOC_EXTENSION)))


def is_test(path) -> Column:
    return any_match(_column(path), rules.TEST_FILE_PATTERNS) & ~is_documentation(path)


def _extension_map(value_of) -> Column:
    pairs = [(e, value_of(name, kind)) for name, kind, extensions in rules.LANGUAGES for e in extensions]
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def _by_extension(path, value_of) -> Column:
    table, ext = _extension_map(value_of), F.substring(extension(path), 2, 1000)
    found = F.coalesce(F.try_element_at(table, ext), F.try_element_at(table, F.lower(ext)))
    return F.when(~base_name(path).isin("Dockerfile", "Makefile"), found)


def language(path) -> Column:
    return _by_extension(path, lambda name, kind: name)


def language_type(path) -> Column:
    return _by_extension(path, lambda name, kind: kind)


def is_test_source(path) -> Column:
    return is_test(path) & ~_column(path).rlike(rules.TEST_SUPPORT) & F.coalesce(language_type(path) == "programming", F.lit(False))


def is_readme(path) -> Column:
    return _column(path).rlike(rules.ROOT_README)


def is_decision_record(path) -> Column:
    return _column(path).rlike(rules.DECISION_RECORD)


def is_assistant_guide(path) -> Column:
    return base_name(path).rlike(rules.ASSISTANT_GUIDE)


def guide_label(path) -> Column:
    """Label of a notable guide at most one directory deep, else null."""
    name = base_name(path)
    labels = F.coalesce(*[F.when(name.rlike(p), F.lit(label)) for p, label in rules.NOTABLE_GUIDES])
    return F.when(depth(path) <= 1, labels)


def doc_role(path) -> Column:
    return F.coalesce(
        F.when(is_readme(path), "readme"),
        F.when(is_decision_record(path), "decision-record"),
        F.when(is_assistant_guide(path), "assistant-guide"),
        F.when(guide_label(path).isNotNull(), "guide"))


def ci_system(path) -> Column:
    return F.coalesce(*[F.when(_column(path).rlike(p), F.lit(n)) for n, p in rules.CI_SYSTEMS])


def is_lockfile(path) -> Column:
    return base_name(path).isin(*rules.LOCKFILES)


def is_vendored(path) -> Column:
    return any_match(_column(path), rules.VENDORED_PATTERNS)


def is_sensitive(path) -> Column:
    return any_match(F.lower(base_name(path)), rules.SENSITIVE_NAME_PATTERNS) | F.lower(_column(path)).rlike(rules.SENSITIVE_DIRECTORY)


def is_manifest(path) -> Column:
    name = base_name(path)
    return name.isin(*rules.MANIFEST_NAMES) | name.rlike(rules.DOTNET_PROJECT)


def is_benchmark(path) -> Column:
    return _column(path).rlike(rules.BENCH_DIRECTORY) | _column(path).rlike(rules.BENCH_NAME)


def area(path) -> Column:
    p = _column(path)
    first = F.substring_index(p, "/", 1)
    return (
        F.when(p.startswith(".github/") | ci_system(p).isNotNull(), "ci")
        .when(~p.contains("/"), F.when(is_documentation(p), "documentation").otherwise("project root"))
        .when(F.lower(first).isin(*rules.SOURCE_ROOTS) & (depth(p) >= 2), F.substring_index(p, "/", 2))
        .otherwise(first))


def topic_key(label) -> Column:
    lowered = F.lower(_column(label))
    last = F.regexp_extract(lowered, r"([^/]+)/*\z", 1)
    last = F.when(last == "", lowered).otherwise(last)
    return F.when(last.isin("tests", "spec"), "test").when(last.isin("documentation", "doc"), "docs").otherwise(last)


def read_priority(path) -> Column:
    """Reading order of an allow-listed file, null when it must not be read."""
    p, name, level = _column(path), base_name(path), depth(path)
    return F.when(~is_sensitive(p) & ~is_vendored(p), F.coalesce(
        F.when(is_manifest(p) & (level <= 2), level),
        F.when(name.rlike(rules.ROOT_TS_CONFIG) & (level == 0), 1),
        F.when(ci_system(p).isNotNull(), 2),
        F.when(is_readme(p), 3),
        F.when(name.rlike(rules.ROOT_LICENSE) & (level == 0), 4),
        F.when(name.rlike(rules.DESIGN_DOC) & (level <= 2), 5),
        F.when(is_decision_record(p), 6),
        F.when(p.rlike(rules.DOCS_ROOT) & is_documentation(p) & p.rlike(rules.MARKDOWN_EXTENSION), 7))).cast("long")
