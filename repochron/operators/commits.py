"""Per-commit facts: line counts, classification, tags, and who counts as a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commits as C
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators.path_dictionary import join_facts, path_facts
from repochron.session import stage

KEY = ["repo_id", "sha"]


def change_facts(changes: DataFrame) -> DataFrame:
    """One row per commit with changes; a single aggregation with map-side partials."""
    facts = path_facts(changes, ["path", "previous_path"], {
        "d": P.is_documentation, "t": P.is_test, "c": lambda p: P.ci_system(p).isNotNull(), "b": lambda p: P.is_lockfile(p) | P.is_manifest(p),
        "ts": P.is_test_source, "v": P.is_vendored, "l": P.is_lockfile})
    lines = lambda c: F.coalesce(F.sum(F.when(~F.col("l"), F.col(c))), F.lit(0)).cast("long").alias(c)
    named = join_facts(changes.select(*KEY, "path", "previous_path", "additions", "deletions"), facts, "path")
    flagged = join_facts(named, facts.select("known_path", "ts"), "previous_path", "p").withColumn("pts", F.coalesce("pts", F.lit(False)))
    return flagged.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("files_changed"), lines("additions"), lines("deletions"),
        F.bool_and("d").alias("only_docs"), F.bool_and("t").alias("only_tests"), F.bool_and("c").alias("only_ci"),
        F.bool_and("b").alias("only_build"), F.bool_or("ts").alias("touches_tests"),
        F.bool_or(~F.col("t") & ~F.col("d") & ~F.col("l") & ~F.col("v")).alias("touches_source"),
        F.count_if("v").alias("vendored"), F.bool_or(F.col("ts") | F.col("pts")).alias("test_commit"))


def kind_from_changes() -> F.Column:
    return F.coalesce(*[F.when(F.col(c), F.lit(k)) for c, k in (
        ("only_docs", "docs"), ("only_tests", "test"), ("only_ci", "ci"), ("only_build", "build"))])


def commit_summaries(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with classification and change facts (one shuffle on repository and commit)."""
    facts = change_facts(changes)
    joined = commits.join(facts, KEY, "left")
    subject = T.trim("subject")
    has_area = subject.rlike(rules.AREA_PREFIX)
    message = F.when(has_area, F.regexp_extract(subject, rules.AREA_PREFIX, 2)).otherwise(subject)
    prepared = joined.withColumn("_message", message).withColumns({
        "is_merge": F.col("n_parents") > 1,
        "automated": C.is_automated("author_name"),
        "_declared": C.declared_kind("subject"),
        "_keyword": C.keyword_kind("_message"),
        "_structural": kind_from_changes(),
    })
    merge = F.col("is_merge")
    conventional_scope = F.lower(T.trim(F.regexp_extract("subject", rules.CONVENTIONAL_PREFIX, 2)))
    area_scope = F.lower(F.when(has_area, F.regexp_extract(subject, rules.AREA_PREFIX, 1)))
    scope = F.when(~merge, F.when(F.col("_declared").isNotNull(), conventional_scope).otherwise(area_scope))
    bang = F.col("_declared").isNotNull() & (F.regexp_extract("subject", rules.CONVENTIONAL_PREFIX, 3) == "!")
    false, zero = F.lit(False), F.lit(0).cast("long")
    return prepared.select(
        "repo_id", "sha", "short_sha", "seq", "n_parents", "author_name", "authored_raw", "authored_ms", "authored_date",
        "subject", "body", "is_merge", "automated",
        F.when(merge, "merge").otherwise(F.coalesce("_declared", "_keyword", "_structural", F.lit("other"))).alias("kind"),
        F.when(merge, "structure").when(F.col("_declared").isNotNull(), "conventional")
        .when(F.col("_keyword").isNotNull(), "keyword").when(F.col("_structural").isNotNull(), "structure")
        .otherwise("none").alias("source"),
        F.when(scope != "", scope).alias("scope"),
        (~merge & (bang | F.col("body").rlike(rules.BREAKING_FOOTER))).alias("breaking"),
        *[F.coalesce(c, zero).alias(c) for c in ("files_changed", "additions", "deletions")],
        (F.coalesce("additions", zero) + F.coalesce("deletions", zero)).alias("churn"),
        *[F.coalesce(c, false).alias(c) for c in ("only_docs", "touches_tests", "touches_source", "test_commit")],
        F.coalesce("vendored", zero).alias("vendored"))


def people(summaries: DataFrame) -> DataFrame:
    """Commits by people; every commit of a repository that has automated ones only.

    The fallback flag comes from one row per repository, so no window spans a repository.  The rows are
    written first: with their size known, the commits are not shuffled for the join.
    """
    flags = stage(summaries.groupBy("repo_id").agg(F.bool_or(~F.col("automated")).alias("_has_people")))
    return summaries.join(flags, "repo_id").filter(~F.col("automated") | ~F.col("_has_people")).drop("_has_people")


def reachable_tags(tags: DataFrame, commits: DataFrame) -> DataFrame:
    kept = tags.join(commits.select(*KEY), KEY, "left_semi")
    return kept.withColumn("weight", C.release_weight("name"))


def tags_by_commit(tags: DataFrame) -> DataFrame:
    """Per commit: the last tag in tag order, the strongest release weight, release names in order."""
    weighted = tags.withColumn("weight", C.release_weight("name"))
    return weighted.groupBy(*KEY).agg(
        F.max_by("name", "pos").alias("tag"), F.max("weight").alias("weight"),
        F.bool_or(F.col("weight") > 0).alias("is_release"))


def with_riding(people_commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds release tags and whether a commit belongs with the work before it."""
    bookkeeping = C.is_release_bookkeeping("kind", "scope", "subject")
    small = (F.col("churn") <= rules.MINOR_COMMIT_LINES) & (F.col("files_changed") <= rules.MINOR_COMMIT_FILES)
    # found before the join, so that texts nobody reads afterwards are not shuffled
    judged = people_commits.withColumns({"bookkeeping": bookkeeping, "_small": small})
    joined = judged.join(tags_by_commit(tags), KEY, "left")
    return joined.withColumns({
        "weight": F.coalesce("weight", F.lit(0.0)),
        "rides": F.col("is_merge") | F.col("bookkeeping") | (F.col("_small") & ~F.coalesce("is_release", F.lit(False))),
    }).select(*people_commits.columns, "tag", "weight", "bookkeeping", "rides")


def commit_topics(summaries: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo_id, sha, topic, weight): the scope counts 1, areas share 1 by changed lines.

    Scopes and changed lines go together through one shuffle by commit, which serves both the sums by topic and their total.
    """
    lines = 1 + F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    known = path_facts(changes, ["path"], {"topic": lambda p: P.topic_key(P.area(p))})
    changed = join_facts(changes.select(*KEY, "path", lines.cast("long").alias("lines")), known, "path").select(*KEY, "topic", "lines", F.lit(None).cast("double").alias("scoped"))
    scopes = summaries.filter("scope is not null").select(*KEY, P.topic_key("scope").alias("topic"), F.lit(None).cast("long").alias("lines"), F.lit(1.0).alias("scoped"))
    by_topic = changed.unionByName(scopes).repartition(*KEY).groupBy(*KEY, "topic").agg(F.sum("lines").cast("double").alias("w"), F.sum("scoped").alias("scoped"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*KEY))
    return by_topic.select(*KEY, "topic", (F.coalesce("scoped", F.lit(0.0)) + F.coalesce(share, F.lit(0.0))).alias("weight"))
