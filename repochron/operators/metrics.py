"""Repository-level activity and language figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import ranking


def file_counts(files: DataFrame) -> DataFrame:
    own = ~P.is_vendored("path")
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("tracked_files"),
        F.count_if(own & P.is_test_source("path")).alias("test_files"),
        F.count_if(own & P.ci_system("path").isNotNull()).alias("ci_configurations"),
        F.count_if(own & P.is_documentation("path")).alias("documentation_files"))


def files_touched(people: DataFrame, changes: DataFrame) -> DataFrame:
    touched = changes.join(people.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
    return touched.groupBy("repo_id", "path").agg(F.lit(1).alias("one")).groupBy("repo_id").agg(F.count("one").alias("files_touched"))


def repo_metrics(summaries: DataFrame, people: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    everyone = summaries.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("is_merge").alias("merge_commits"),
        F.count_if("automated").alias("automated_commits"),
        F.array_sort(F.collect_set(F.when(F.col("automated"), F.col("author_name")))).alias("automated_authors"))
    moment = F.struct("authored_ms", "seq")
    active = people.groupBy("repo_id").agg(
        F.count_distinct("author_name").alias("contributors"), F.count_distinct("authored_date").alias("active_days"),
        F.min_by("authored_raw", moment).alias("first_commit_at"), F.max_by("authored_raw", moment).alias("latest_commit_at"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    joined = everyone.join(active, "repo_id").join(files_touched(people, changes), "repo_id", "left").join(file_counts(files), "repo_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "repo_id", "commits", "merge_commits", "automated_commits", "automated_authors", "contributors",
        "first_commit_at", "latest_commit_at", T.inclusive_days("first_commit_at", "latest_commit_at").alias("timespan_days"),
        "active_days", *[F.coalesce(c, zero).alias(c) for c in ("tracked_files", "files_touched")], "additions", "deletions",
        *[F.coalesce(c, zero).alias(c) for c in ("test_files", "ci_configurations", "documentation_files")])


def language_shares(files: DataFrame) -> DataFrame:
    counted = files.filter((F.col("kind") != "symlink") & ~P.is_vendored("path")).withColumns(
        {"language": P.language("path"), "language_type": P.language_type("path")})
    totals = counted.filter(F.col("language_type").isin("programming", "markup")).groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    everything = F.sum("bytes").over(Window.partitionBy("repo_id"))  # at most one row per language
    order = Window.partitionBy("repo_id").orderBy(F.col("bytes").desc(), T.locale_key("language"))
    return totals.select(
        "repo_id", "language", "files", "bytes", F.coalesce(F.try_divide("bytes", everything), F.lit(0.0)).alias("share"),
        F.row_number().over(order).cast("long").alias("rank"))


def percent_label(share, smallest: float) -> F.Column:
    """Rounded percent; "<1" below the given share (two rules exist, 0.5% and 1%)."""
    share = F.col(share) if isinstance(share, str) else share
    return F.when(share < smallest, "<1").otherwise(F.floor(share * 100 + 0.5).cast("string"))


def language_signals(files: DataFrame) -> DataFrame:
    """Leading languages with their extensions and the first five of their files."""
    shown = language_shares(files).filter((F.col("rank") <= 6) & ((F.col("share") >= 0.02) | (F.col("rank") == 1)))
    known = files.select("repo_id", "path", P.language("path").alias("language"), P.extension("path").alias("extension")).filter("language is not null")
    extensions = known.groupBy("repo_id", "language").agg(F.array_sort(F.collect_set("extension")).alias("extensions"))
    samples = ranking.first_rows(known, ["repo_id", "language"], [F.col("path")], 5).groupBy("repo_id", "language").agg(
        F.array_sort(F.collect_list("path")).alias("samples"))
    return shown.join(extensions, ["repo_id", "language"]).join(samples, ["repo_id", "language"])


def kind_counts(commits: DataFrame, group: list[str]) -> DataFrame:
    """Per group the worded kind mix, e.g. "3 features and 1 fix"."""
    singular = F.create_map(*[F.lit(v) for k, (one, _) in rules.KIND_NOUNS.items() for v in (k, one)])
    many = F.create_map(*[F.lit(v) for k, (_, n) in rules.KIND_NOUNS.items() for v in (k, n)])
    per_kind = commits.groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "kind", "n")))
    noun = lambda e: F.when(e["n"] == 1, F.element_at(singular, e["kind"])).otherwise(F.element_at(many, e["kind"]))
    worded = F.transform("entries", lambda e: F.concat_ws(" ", T.format_count(e["n"]), noun(e)))
    return per_kind.groupBy(*group).agg(
        entries.alias("entries"), F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds")
    ).select(*group, "kinds", T.join_words(worded).alias("kind_text"))


def commit_kind_mix(people: DataFrame) -> DataFrame:
    work = people.filter(~F.col("is_merge"))
    shares = work.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("commits"), F.avg((F.col("source") == "conventional").cast("double")).alias("conventional_share"))
    level = F.when(F.col("conventional_share") >= 0.8, "observed").otherwise("inferred")
    how = F.when(level == "observed", "as labeled by their Conventional Commits prefixes").otherwise("classified from commit wording and changed files")
    return shares.filter("commits >= 2").join(kind_counts(work, ["repo_id"]), "repo_id").select(
        "repo_id", "commits", "conventional_share", level.alias("level"),
        F.concat(F.lit("By type, the commits comprise "), F.col("kind_text"), F.lit(", "), how, F.lit(".")).alias("text"))


def top_level_directories(files: DataFrame) -> DataFrame:
    """Distinct own top-level directories: their number, the first 12 and the worded first 6."""
    first = F.substring_index("path", "/", 1)
    directories = files.filter(F.col("path").contains("/") & ~P.is_vendored("path")).select("repo_id", first.alias("directory")).filter(
        (F.col("directory") != "") & ~F.col("directory").startswith(".")).distinct()
    totals = directories.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    shown = ranking.first_rows(directories, ["repo_id"], [F.col("directory")], 12).groupBy("repo_id").agg(
        F.array_sort(F.collect_list("directory")).alias("directories"))
    named = F.transform(F.slice("directories", 1, 6), lambda d: T.code_span(F.concat(d, F.lit("/"))))
    rest = F.col("total") - F.least(F.col("total"), F.lit(6))
    words = F.when(rest > 0, F.array_append(named, T.plural(rest, "other directory", "other directories"))).otherwise(named)
    return totals.join(shown, "repo_id").select("repo_id", "total", "directories", T.join_words(words).alias("text"))
