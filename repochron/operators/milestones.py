"""Milestones: work units, their features, the grouping, and what each group is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import clustering, metrics, ranking
from repochron.operators import commits as K
from repochron.operators import evidence as E
from repochron.operators import practice
from repochron.session import stage

M = ["repo_id", "milestone"]
METHOD = (
    "Adjacent commits were grouped by shared scopes and directories, commit type, and time proximity; a tagged commit usually ends "
    "a milestone. Merges, release bookkeeping, and very small commits stay with the work before them. The grouping is an interpretation of the history.")


def unit_commits(riding: DataFrame) -> DataFrame:
    """Adds the work unit: a commit opens one unless it rides along; the first always does.

    One row per repository or milestone is written before it is joined, here and below: with its size
    known, the commits are not shuffled for it.
    """
    firsts = stage(riding.groupBy("repo_id").agg(F.min("seq").alias("first_seq")))
    marked = riding.join(firsts, "repo_id").withColumn("starts", ~F.col("rides") | (F.col("seq") == F.col("first_seq")))
    numbered = ranking.prefix_sum(marked, ["repo_id"], "seq", F.col("starts").cast("long"), "unit")
    return numbered.withColumn("unit", F.col("unit") - 1).drop("first_seq")


def unit_features(units: DataFrame, topics: DataFrame) -> DataFrame:
    """One compact row per unit.

    All commits of a unit but its opener ride along and are left out of its vectors, so the
    vectors are the opener's, or empty when a longer unit opens with a riding commit.
    """
    rows = stage(units.groupBy("repo_id", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("authored_ms").alias("start"), F.max("authored_ms").alias("end"),
        F.max("weight").alias("weight"), F.sum("churn").alias("churn"),
        F.min_by(F.struct("sha", "kind", "rides"), "seq").alias("opener")))
    totals = stage(rows.groupBy("repo_id").agg(F.sum("n").alias("all_n"), F.sum("churn").alias("all_churn")))
    counted = (F.col("n") == 1) | ~F.col("opener.rides")
    # all commits' topics: they are in groups by commit already, and openers would be shuffled once more to pick theirs
    vectors = topics.groupBy(*K.KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "weight")))).alias("topics"))
    share = F.col("n") / F.col("all_n")
    mass = F.when(F.col("all_churn") == 0, share).otherwise(0.5 * share + 0.5 * F.col("churn") / F.col("all_churn"))
    no_weights = F.create_map().cast("map<string,double>")
    kinds = F.when(counted, F.create_map(F.col("opener.kind"), F.lit(1.0))).otherwise(no_weights)
    prepared = rows.join(totals, "repo_id").withColumn("sha", F.when(counted, F.col("opener.sha")))
    return prepared.join(vectors, K.KEY, "left").select(
        "repo_id", "unit", "n", "start", "end", F.coalesce("topics", no_weights).alias("topics"), kinds.alias("kinds"), "weight",
        mass.alias("mass"), "churn")


def adjacent_merge_cost(features: DataFrame) -> DataFrame:
    limits = stage(clustering.repository_limits(features))
    costs = clustering.pair_costs(features.withColumnRenamed("unit", "pos").join(limits, "repo_id"))
    return costs.select("repo_id", F.col("pos").alias("unit"), (F.col("pos") + 1).alias("next_unit"), "cost")


def members(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Commits with their milestone; the ranges are a dozen rows per repository."""
    return units.join(ranges.withColumnRenamed("repo_id", "_r"), (units.repo_id == F.col("_r")) & units.unit.between(
        F.col("first_unit"), F.col("last_unit"))).drop("_r", "first_unit", "last_unit")


def with_described(member_rows: DataFrame) -> DataFrame:
    """Marks the commits titles describe: substantive ones, or all non-merge ones if there are none."""
    substantive = ~F.col("is_merge") & ~F.col("rides")
    flags = stage(member_rows.groupBy(*M).agg(F.bool_or(substantive).alias("_any")))
    return member_rows.join(flags, M).withColumn("described", ~F.col("is_merge") & (~F.col("rides") | ~F.col("_any"))).drop("_any")


def member_changes(described: DataFrame, changes: DataFrame) -> DataFrame:
    facts = described.filter(~F.col("is_merge")).select(*M, "sha", "described")
    return changes.join(facts, K.KEY)


def path_churn(changed: DataFrame) -> DataFrame:
    """Changed lines of each path of a milestone, by what titles describe and not: one row for all its changes."""
    lines = 1 + F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    return changed.groupBy(*M, "described", "path").agg(F.sum(lines).alias("churn"))


def milestone_stats(member_rows: DataFrame, changed: DataFrame) -> DataFrame:
    moment = F.struct("authored_ms", "seq")
    work = ~F.col("is_merge")
    rows = member_rows.groupBy(*M).agg(
        F.count(F.lit(1)).alias("commits"), F.coalesce(F.sum(F.when(work, F.col("additions"))), F.lit(0)).alias("additions"),
        F.coalesce(F.sum(F.when(work, F.col("deletions"))), F.lit(0)).alias("deletions"),
        F.min_by("authored_raw", moment).alias("start_at"), F.max_by("authored_raw", moment).alias("end_at"),
        F.min_by("sha", "seq").alias("first_sha"), F.max_by("sha", "seq").alias("last_sha"))
    files = changed.groupBy(*M, "path").agg(F.lit(1).alias("one")).groupBy(*M).agg(F.count("one").alias("files_changed"))
    kinds = metrics.kind_counts(member_rows, M)
    return rows.join(files, M, "left").join(kinds, M).withColumn("files_changed", F.coalesce("files_changed", F.lit(0).cast("long")))


def milestone_tags(member_rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Project releases inside each milestone, in history order (child rows, however many)."""
    from repochron.functions.commits import release_weight

    releases = tags.withColumn("weight", release_weight("name")).filter("weight > 0").select(*K.KEY, "name", "pos")
    return releases.join(member_rows.select(*M, "sha", "seq"), K.KEY).select(*M, "name", "sha", "seq", "pos")


def top_areas(changed: DataFrame) -> DataFrame:
    """Of changes or of their sums by path (``path_churn``)."""
    paths = changed if "churn" in changed.columns else path_churn(changed)
    churn = paths.filter("described").groupBy(*M, P.area("path").alias("area")).agg(F.sum("churn").alias("churn"))
    return ranking.first_rows(churn, M, [F.col("churn").desc(), T.locale_key("area")], 3)


def themes(described: DataFrame, topics: DataFrame) -> DataFrame:
    """Ranked themes of each milestone with the spelling that carries most weight."""
    commits = described.filter("described").select(*M, "sha", "seq", "scope")
    scope_key = P.topic_key("scope")
    scopes = commits.filter("scope is not null").select(*M, "seq", scope_key.alias("theme"), F.col("scope").alias("label"), F.lit(1.0).alias("w"))
    areas = topics.join(commits, K.KEY).filter(scope_key.isNull() | (F.col("topic") != scope_key)).select(
        *M, "seq", F.col("topic").alias("theme"), F.col("topic").alias("label"), (F.col("weight") * 0.75).alias("w"))
    bonus = F.when(F.col("label") == F.col("theme"), 0.5).otherwise(0.0)
    spelled = scopes.unionByName(areas).groupBy(*M, "theme", "label").agg(
        F.sum("w").alias("w"), F.round(F.sum(F.col("w") + bonus), 9).alias("spelling"), F.min("seq").alias("first"))
    weighted = spelled.groupBy(*M, "theme").agg(
        F.round(F.sum("w"), 9).alias("weight"), F.max_by("label", F.struct("spelling", -F.col("first"))).alias("label")).filter("theme <> 'project root'")
    weighted = stage(weighted)
    leaders = weighted.groupBy(*M).agg(F.max("weight").alias("leader"))
    return weighted.join(leaders, M).filter(F.col("weight") >= F.col("leader") * rules.MIN_THEME_WEIGHT).drop("leader")


def theme_words(theme_rows: DataFrame) -> DataFrame:
    """Per milestone: the first six themes, how many there are, which restate a kind."""
    totals = theme_rows.groupBy(*M).agg(
        F.count(F.lit(1)).alias("theme_count"), *[F.bool_or(F.col("theme") == k).alias(f"has_{k}") for k in ("docs", "test", "ci")])
    first = ranking.first_rows(theme_rows, M, [F.col("weight").desc(), T.locale_key("theme")], 6).groupBy(*M).agg(
        F.array_sort(F.collect_list(F.struct("rank", "theme", "label"))).alias("first_themes"))
    return totals.join(first, M)


def work_label(described: DataFrame) -> DataFrame:
    per_kind = described.filter("described").groupBy(*M, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("churn").alias("churn"))
    priority = F.array_position(F.array(*[F.lit(k) for k in rules.KIND_PRIORITY]), F.col("kind"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.col("churn")).alias("b"), priority.alias("c"), "kind", "n")))
    rows = per_kind.groupBy(*M).agg(entries.alias("all"), F.sum("n").alias("total"), F.sum(F.when(F.col("kind") != "other", F.col("n")).otherwise(0)).alias("known"))
    basis = F.when(F.col("known") >= F.col("total") / 2, F.filter("all", lambda e: e["kind"] != "other")).otherwise(F.col("all"))
    size = F.when(F.col("known") >= F.col("total") / 2, F.col("known")).otherwise(F.col("total"))
    ranked = rows.select(*M, basis.alias("ranked"), F.greatest(size, F.lit(1)).alias("size"))
    first, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    label = F.create_map(*[F.lit(v) for pair in rules.KIND_LABELS.items() for v in pair])
    name = lambda e: F.element_at(label, e["kind"])
    development = F.lit(rules.KIND_LABELS["other"])
    return ranked.select(*M, (
        F.when(first.isNull() | (first["kind"] == "other"), development)
        .when(first["n"] / F.col("size") >= 0.6, name(first))
        .when(second.isNotNull() & (second["kind"] != "other") & ((first["n"] + second["n"]) / F.col("size") >= 0.75),
              F.concat(name(first), F.lit(" and "), F.lower(name(second))))
        .otherwise(development)).alias("label"))


def describe_area(area) -> Column:
    plain = F.create_map(*[F.lit(v) for pair in rules.PLAIN_AREAS.items() for v in pair])
    return F.coalesce(F.try_element_at(plain, area), T.code_span(F.concat(area, F.lit("/"))))


def milestones(member_rows: DataFrame, changes: DataFrame, topics: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per milestone.  Commits and tags stay child tables (``members``, ``milestone_tags``)."""
    described = with_described(member_rows)
    changed = stage(path_churn(member_changes(described, changes)))
    stats = milestone_stats(member_rows, changed)
    areas = top_areas(changed).groupBy(*M).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "area"))), lambda a: describe_area(a["area"])).alias("areas"))
    order = F.struct("seq", "pos")
    tag_ends = milestone_tags(member_rows, tags).groupBy(*M).agg(
        F.count(F.lit(1)).alias("tag_count"), F.min_by(F.struct("name", "sha"), order).alias("ft"), F.max_by(F.struct("name", "sha"), order).alias("lt"))
    rows = stats.join(areas, M, "left").join(tag_ends, M, "left").join(work_label(described), M, "left").join(theme_words(themes(described, topics)), M, "left")
    label = F.coalesce("label", F.lit(rules.KIND_LABELS["other"]))
    lowered = F.lower(label)
    restated = [(k, lowered.contains(rules.KIND_LABELS[k].lower())) for k in ("docs", "test", "ci")]
    hidden = lambda t: F.exists(F.array(*[F.when(flag, F.lit(k)).otherwise("") for k, flag in restated]), lambda k: k == t["theme"])
    shown = F.filter("first_themes", lambda t: ~hidden(t))
    named = F.transform(F.slice(shown, 1, 3), lambda t: t["label"])
    hidden_count = sum((F.when(flag & F.coalesce(f"has_{k}", F.lit(False)), 1).otherwise(0) for k, flag in restated), F.lit(0))
    others = F.coalesce("theme_count", F.lit(0)) - hidden_count - F.coalesce(F.size(named), F.lit(0))
    theme_text = F.when(others > 0, F.concat(F.array_join(named, ", "), F.lit(", and "), others, F.lit(" other area"), T.plural_suffix(others))).otherwise(T.join_words(named))
    titled = F.concat(label, F.when(F.coalesce(F.size(named), F.lit(0)) > 0, F.concat(F.lit(": "), theme_text)).otherwise(""))
    tag_range = F.when(F.col("tag_count") > 1, F.concat(F.col("ft.name"), F.lit(" – "), F.col("lt.name"))).otherwise(F.col("ft.name"))
    start, end = T.format_date("start_at"), T.format_date("end_at")
    n = F.col("commits")
    span = F.when(start == end, F.concat(F.lit("on "), start)).otherwise(F.concat(F.lit("from "), start, F.lit(" to "), end))
    counted = F.concat(n, F.lit(" commit"), T.plural_suffix(n))
    summary = F.concat_ws(
        " ", F.concat(counted, F.lit(" "), span, F.lit(": "), F.col("kind_text"), F.lit(".")),
        F.when(F.size("areas") > 0, F.concat(F.lit("Most changed: "), T.join_words("areas"), F.lit("."))),
        F.when(F.col("additions") + F.col("deletions") > 0, F.concat(
            T.format_count("additions"), F.lit(" line"), T.plural_suffix("additions"), F.lit(" added and "), T.format_count("deletions"),
            F.lit(" removed across "), F.col("files_changed"), F.lit(" file"), T.plural_suffix("files_changed"), F.lit("."))))
    name = F.concat(F.lit("M"), F.col("milestone"))
    grouped = E.draft("inferred", "milestone", F.concat(counted, F.lit(" grouped as milestone "), name, F.lit(".")), basis=F.lit(METHOD),
                      kind="commit-range", first_sha=F.col("first_sha"), last_sha=F.col("last_sha"), count=n)
    first_tag = F.when(F.col("ft").isNotNull(), practice.tag_draft(F.col("ft.name"), F.col("ft.sha")))
    last_tag = F.when(F.col("ft.name") != F.col("lt.name"), practice.tag_draft(F.col("lt.name"), F.col("lt.sha")))
    return rows.select(
        "repo_id", "milestone", name.alias("id"), F.concat_ws(" · ", tag_range, titled).alias("title"), summary.alias("summary"), "start_at", "end_at",
        "commits", F.coalesce(F.transform("first_themes", lambda t: t["label"]), F.array().cast("array<string>")).alias("themes"), "kinds",
        F.coalesce("tag_count", F.lit(0).cast("long")).alias("tag_count"), F.col("ft.name").alias("first_tag"), F.col("lt.name").alias("last_tag"),
        "additions", "deletions", "files_changed", E.drafts(grouped, first_tag, last_tag).alias("drafts"))


def commit_listing(member_rows: DataFrame) -> DataFrame:
    """The first twelve commits of each milestone and how many more there are."""
    totals = member_rows.groupBy(*M).agg(F.count(F.lit(1)).alias("commits"))
    shown = ranking.first_rows(member_rows.select(*M, "seq", "short_sha", "subject"), M, [F.col("seq")], rules.MAX_COMMITS_PER_MILESTONE)
    return shown.join(totals, M).select(*M, "rank", "short_sha", "subject", F.greatest(F.col("commits") - rules.MAX_COMMITS_PER_MILESTONE, F.lit(0)).alias("more"))
