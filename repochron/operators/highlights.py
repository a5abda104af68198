"""Commits that show best how the work was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import text as T
from repochron.operators import evidence as E
from repochron.operators import ranking
from repochron.operators.commits import KEY
from repochron.session import stage

M = ["repo_id", "milestone"]


def commit_context(member_rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Members with the tag shown for them: the last one in tag order on that commit."""
    last = tags.groupBy(*KEY).agg(F.max_by("name", "pos").alias("any_tag"))
    return member_rows.join(last, KEY, "left")


def eligible(context: DataFrame) -> DataFrame:
    return context.filter(~F.col("is_merge") & (F.col("files_changed") > 0) & (F.col("churn") > 0))


def largest_in_milestone(candidates: DataFrame) -> DataFrame:
    """The biggest commit of each milestone with at least three candidates."""
    rows = candidates.groupBy(*M).agg(F.count(F.lit(1)).alias("n"), F.max_by("sha", F.struct("churn", -F.col("seq"))).alias("sha"))
    return rows.filter("n >= 3").select(*M, "sha")


def commit_score(candidates: DataFrame, decision_shas: DataFrame) -> DataFrame:
    """Score and reasons of every eligible commit."""
    largest = stage(largest_in_milestone(candidates).select("repo_id", "sha", F.lit(True).alias("is_largest")))
    decided = stage(decision_shas.select(*KEY).distinct().withColumn("is_decision", F.lit(True)))
    no = F.lit(False)
    rows = candidates.join(largest, KEY, "left").join(decided, KEY, "left").withColumns(
        {"is_largest": F.coalesce("is_largest", no), "is_decision": F.coalesce("is_decision", no)})
    lines = F.size(F.filter(F.split("body", "\n"), lambda s: T.trim(s) != ""))
    explains = F.length(T.trim("body")) >= 40
    tested = F.col("touches_tests") & F.col("touches_source")
    bulk = (F.col("files_changed") > 150) | (F.col("vendored") > F.col("files_changed") / 2)
    add = lambda condition, value: F.when(condition, value).otherwise(0.0)
    score = (
        F.least(F.lit(5.0), F.log2(1.0 + F.col("churn")) * 0.5) + add(explains, 2.0) + add(tested, 1.5)
        + add(F.col("kind").isin("feat", "fix", "perf", "refactor"), 1.0) - add(F.col("kind").isin("docs", "style", "chore", "build", "ci"), 1.0)
        + add(F.col("is_decision"), 1.5) + add(F.col("any_tag").isNotNull(), 1.0) - add(bulk, 3.0))
    reasons = F.array_compact(F.array(
        F.when(explains, F.concat(F.lit("Message body explains the change ("), lines, F.lit(" line"), T.plural_suffix(lines), F.lit(")"))),
        F.when(tested, F.lit("Changes tests alongside implementation")),
        F.when(F.col("is_decision"), F.lit("Commit message records a technical decision")),
        F.when(F.col("any_tag").isNotNull(), F.concat(F.lit("Tagged "), T.code_span("any_tag"))),
        F.when(F.col("is_largest"), F.concat(F.lit("Largest change in milestone M"), F.col("milestone"), F.lit(" (+"), T.format_count("additions"),
                                             F.lit(" −"), T.format_count("deletions"), F.lit(")")))))
    return rows.withColumns({"score": F.round(score, 9), "reasons": reasons})


#: more than any score in either direction, and more commits than a repository has
_SCORE_SPAN, _POSITIONS = 14, 1 << 28


def order_key(score: str = "score", seq: str = "seq") -> Column:
    """Scores from the greatest on, to all nine digits, equal ones by position, as one BIGINT."""
    return (F.lit(_SCORE_SPAN * 10**9) - F.round(F.col(score) * 10**9)).cast("long") * F.lit(_POSITIONS) + F.col(seq)


def commit_score_rank(scored: DataFrame) -> DataFrame:
    """Rank by score, then position; scores of a huge repository are never sorted in one task."""
    return ranking.number_rows_by_key(scored.withColumn("_key", order_key()), ["repo_id"], "_key", "rank").drop("_key")


def with_median(scored: DataFrame) -> DataFrame:
    """Adds the number of eligible commits and the score at floor(n / 2) of the descending list.

    The median is found by counting; no ranking of the commits is made for it.
    """
    totals = stage(scored.groupBy("repo_id").agg(F.count(F.lit(1)).alias("eligible")))
    keyed = scored.select("repo_id", "score", order_key().alias("_key")).join(totals, "repo_id").withColumn("_k", F.floor(F.col("eligible") / 2) + 1)
    medians = ranking.row_at(keyed, ["repo_id"], "_key", "_k").select("repo_id", F.col("score").alias("median"))
    return scored.join(stage(totals.join(medians, "repo_id")), "repo_id")


def milestone_best_commit(scored: DataFrame) -> DataFrame:
    """Best commit of each milestone, if it is no worse than the median of the repository."""
    best = stage(scored.groupBy(*M).agg(F.min(order_key()).alias("_best")))
    return scored.join(best, M).filter((order_key() == F.col("_best")) & (F.col("score") >= F.col("median"))).drop("_best")


def selected_commits(scored: DataFrame, changes: DataFrame) -> DataFrame:
    """Up to six commits: the best of each milestone first, filled up by score, shown by position.

    ``scored`` carries the median (``with_median``).  The six are found by group limits.
    """
    order, six = [order_key()], rules.MAX_SELECTED_COMMITS
    best = ranking.first_rows(milestone_best_commit(scored), ["repo_id"], order, six, "place").withColumn("tier", F.lit(0))
    others = ranking.first_rows(scored, ["repo_id"], order, six, "place").join(best.select(*KEY), KEY, "left_anti").withColumn("tier", F.lit(1))
    wanted = F.least(F.lit(six), F.greatest(F.lit(1), F.ceil(F.col("eligible") / 3)))
    both = best.unionByName(others).drop("place").withColumn("wanted", wanted)
    chosen = stage(ranking.first_rows(both, ["repo_id"], [F.col("tier"), *order], six, "place").filter("place <= wanted"))
    files = ranking.first_rows(changes.join(chosen.select(*KEY), KEY, "left_semi"), KEY, [F.col("pos")], 10, "r").groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]).alias("files"))
    n = F.col("files_changed")
    item = E.draft(
        "observed", "history",
        F.concat(F.lit("Commit "), T.code_span("short_sha"), F.lit(': "'), F.col("subject"), F.lit('" changed '), n, F.lit(" file"), T.plural_suffix(n),
                 F.lit(" (+"), F.col("additions"), F.lit(" −"), F.col("deletions"), F.lit(").")),
        kind="commit", sha=F.col("sha"), short_sha=F.col("short_sha"), date=F.col("authored_date"), files=F.col("files"))
    fallback = F.array(F.lit("Among the most substantial changes in the history"))
    return chosen.join(files, KEY).select(
        "repo_id", "sha", "short_sha", "seq", "authored_raw", "subject", "files_changed", "additions", "deletions",
        F.concat(F.lit("M"), F.col("milestone")).alias("milestone"), F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(fallback).alias("reasons"),
        E.drafts(item).alias("drafts"))
