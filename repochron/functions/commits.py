"""Commit-level predicates and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_automated(author_name) -> Column:
    return T.trim(author_name).rlike(rules.AUTOMATED_AUTHOR)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def declared_kind(subject) -> Column:
    """Kind declared by a Conventional Commits prefix of a known type, else null."""
    word = F.lower(F.regexp_extract(_column(subject), rules.CONVENTIONAL_PREFIX, 1))
    return F.try_element_at(_literal_map(rules.TYPE_ALIASES), word)


def keyword_kind(message) -> Column:
    return F.coalesce(*[F.when(_column(message).rlike(p), F.lit(k)) for p, k in rules.KEYWORD_KINDS])


def subject_text(subject) -> Column:
    s = _column(subject)
    after = F.substring(s, F.instr(s, ":") + 1, F.length(s))
    return T.trim(F.when(declared_kind(s).isNotNull(), after).otherwise(s))


def decision_text(subject) -> Column:
    return F.regexp_replace(subject_text(subject), rules.AREA_PREFIX_STRIP, "")


def states_choice(subject, only_docs) -> Column:
    # one pattern, so that the text is found once
    explicit = decision_text(subject).rlike("|".join(f"(?:{p})" for p in rules.EXPLICIT_CHOICE_SUBJECTS))
    return explicit & ~_column(subject).rlike(rules.TYPO_WORD) & ~F.coalesce(_column(only_docs), F.lit(False))


def is_release_bookkeeping(kind, scope, subject) -> Column:
    return F.coalesce(_column(scope) == "release", F.lit(False)) | (
        _column(kind).isin("chore", "build", "other") & subject_text(subject).rlike(rules.RELEASE_SUBJECT))


def release_weight(name) -> Column:
    n = T.trim(name)
    suffix = F.regexp_extract(n, rules.PROJECT_VERSION, 4)
    patch = F.regexp_extract(n, rules.PROJECT_VERSION, 3)
    return (
        F.when(~n.rlike(rules.PROJECT_VERSION), 0.0)
        .when((suffix != "") & suffix.rlike(rules.PRERELEASE_SUFFIX), 0.3)
        .when((suffix != "") & ~suffix.rlike("^[0-9]"), 0.0)
        .when(patch.rlike("^0*\\z"), 1.0)
        .otherwise(0.5))


def weighted_jaccard(a, b) -> Column:
    """Similarity of two weight maps, each scaled to sum 1."""
    a, b = _column(a), _column(b)

    def total(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v)

    sum_a, sum_b = total(a), total(b)
    pairs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(
        (F.coalesce(x, F.lit(0.0)) / sum_a).alias("x"), (F.coalesce(y, F.lit(0.0)) / sum_b).alias("y"))))
    low = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.least(p["x"], p["y"]))
    high = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.greatest(p["x"], p["y"]))
    return (
        F.when((sum_a == 0) & (sum_b == 0), 1.0)
        .when((sum_a == 0) | (sum_b == 0), 0.0)
        .otherwise(low / high))


def time_gap_cost(gap_hours) -> Column:
    return F.least(F.lit(1.0), F.log1p(_column(gap_hours)) / F.log1p(F.lit(float(rules.TIME_SATURATION_HOURS))))
