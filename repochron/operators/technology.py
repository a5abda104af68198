"""Tools seen in tracked files and dependencies, and how they came and went."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import evidence as E
from repochron.operators import metrics, ranking
from repochron.operators.path_dictionary import join_facts, path_facts
from repochron.session import stage


def marker_table(spark: SparkSession, markers=None) -> DataFrame:
    """The marker rules as rows; bounded by the rule list, so it is safe to broadcast."""
    rows = [(i, m[0], m[1], m[2]) for i, m in enumerate(markers or rules.MARKERS)]
    return spark.createDataFrame(rows, "marker_pos int, tool string, kind string, tool_group string")


def matching_markers(path, markers=None) -> Column:
    """Positions of the markers a path satisfies, as an array.

    Name equality goes through one map lookup; only the pattern rules are tested one by
    one.  Everything is a map-side expression: matching never joins paths with rules.
    """
    p = F.col(path) if isinstance(path, str) else path
    name = P.base_name(p)
    by_name: dict[str, list[int]] = {}
    by_path: dict[str, list[int]] = {}
    tests = []
    for i, (_, _, _, match, values) in enumerate(markers or rules.MARKERS):
        if match in ("base", "path"):
            for value in values:
                (by_name if match == "base" else by_path).setdefault(value, []).append(i)
            continue
        test = {
            "stem": lambda v: (name == v) | name.startswith(v + "."),
            "base_re": lambda v: name.rlike(v), "path_re": lambda v: p.rlike(v),
            "prefix": lambda v: p.startswith(v), "suffix": lambda v: p.endswith(v),
        }[match]
        tests.append(F.when(reduce(lambda a, b: a | b, [test(v) for v in values]), F.lit(i)))

    def lookup(table: dict[str, list[int]], key: Column) -> Column:
        entries = [c for k, v in table.items() for c in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
        return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.array().cast("array<int>"))

    return F.when(p.isNotNull(), F.concat(lookup(by_name, name), lookup(by_path, p), F.array_compact(F.array(*tests))))


def _described(matches: DataFrame, markers=None) -> DataFrame:
    return matches.join(F.broadcast(marker_table(matches.sparkSession, markers)), "marker_pos")


def marker_matches(files: DataFrame, markers=None) -> DataFrame:
    own = files.filter(~P.is_vendored("path")).select("repo_id", "path")
    hits = own.select("repo_id", "path", F.explode(matching_markers("path", markers)).alias("marker_pos"))
    return _described(hits, markers).select("repo_id", "path", "tool", "kind", "tool_group", "marker_pos")


def marker_files(matches: DataFrame) -> DataFrame:
    """Per tool the number of files and the first ten paths in file order."""
    group = ["repo_id", "tool", "kind", "marker_pos"]
    totals = matches.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    first = ranking.first_rows(matches, group, [F.col("path")], 10).groupBy(*group).agg(
        F.array_sort(F.collect_list("path")).alias("paths"))
    return totals.join(first, group)


# ---------------------------------------------------------------------- signals
def dependency_rule_table(spark: SparkSession) -> DataFrame:
    rows = [(eco, i, name.rstrip("*"), name.endswith("*"), tool, kind)
            for eco, listed in rules.DEPENDENCY_RULES.items() for i, (name, tool, kind) in enumerate(listed)]
    return spark.createDataFrame(rows, "ecosystem string, rule_pos int, match string, is_prefix boolean, name string, kind string")


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """(repo_id, path, manifest_pos, ecosystem, section, dep_pos, dependency)."""
    def section(column: str, label: str, order: int) -> Column:
        return F.transform(column, lambda d, i: F.struct(
            F.lit(label).alias("section"), (i + order * 100000).alias("dep_pos"), d.alias("dependency")))

    both = F.concat(section("dependencies", "dependencies", 0), section("dev_dependencies", "development dependencies", 1))
    return manifests.select("repo_id", "path", "manifest_pos", "ecosystem", F.explode(both).alias("d")).select(
        "repo_id", "path", "manifest_pos", "ecosystem", "d.*")


def dependency_technologies(manifests: DataFrame) -> DataFrame:
    """First matching rule per declared dependency."""
    declared = declared_dependencies(manifests)
    table = F.broadcast(dependency_rule_table(manifests.sparkSession))
    hit = (declared.ecosystem == table.ecosystem) & (
        (~table.is_prefix & (declared.dependency == table.match)) | (table.is_prefix & declared.dependency.startswith(table.match)))
    key = ["repo_id", "path", "manifest_pos", "section", "dep_pos", "dependency"]
    return declared.join(table, hit).groupBy(*[declared[c] for c in key]).agg(
        F.min_by(F.struct("name", "kind"), "rule_pos").alias("t")).select(*key, "t.name", "t.kind")


SIGNAL_COLUMNS = ["repo_id", "ord", "name", "kind", "level", "basis", "drafts"]


def language_signal_rows(files: DataFrame) -> DataFrame:
    s = metrics.language_signals(files)
    percent = metrics.percent_label("share", 0.005)
    spans = F.array_join(F.transform("extensions", T.code_span), "/")
    basis = F.concat(F.col("files"), F.lit(" "), spans, F.lit(" file"), T.plural_suffix("files"), F.lit(" ("), percent,
                     F.lit("% of source bytes), classified by file extension"))
    item = E.draft(
        "inferred", "technology", F.concat(F.col("language"), F.lit(" accounts for about "), percent, F.lit("% of tracked source bytes.")),
        basis=F.lit("Classified by file extension; vendored, generated, data, and documentation files are excluded."),
        kind="file-set", description=F.concat(F.lit("Tracked "), F.col("language"), F.lit(" files at HEAD")),
        total=F.col("files"), paths=F.col("samples"))
    return s.select("repo_id", F.col("rank").alias("ord"), F.col("language").alias("name"), F.lit("language").alias("kind"),
                    F.lit("inferred").alias("level"), basis.alias("basis"), E.drafts(item).alias("drafts"))


def marker_signal_rows(files: DataFrame) -> DataFrame:
    m = marker_files(marker_matches(files))
    only = F.col("paths")[0]
    shown = F.array_join(F.transform(F.slice("paths", 1, 3), T.code_span), ", ")
    basis = F.concat(shown, F.when(F.col("n") > 3, F.concat(F.lit(" and "), F.col("n") - 3, F.lit(" more"))).otherwise(""), F.lit(" tracked"))
    single = E.draft("observed", "technology", F.concat(T.code_span(only), F.lit(" is tracked in the repository.")), kind="file", path=only)
    many = E.draft("observed", "technology", F.concat(F.col("n"), F.lit(" "), F.col("tool"), F.lit(" files are tracked in the repository.")),
                   kind="file-set", description=F.concat(F.col("tool"), F.lit(" files")), total=F.col("n"), paths=F.col("paths"))
    return m.select("repo_id", (F.col("marker_pos") + 100).cast("long").alias("ord"), F.col("tool").alias("name"), "kind",
                    F.lit("observed").alias("level"), basis.alias("basis"),
                    E.drafts(F.when(F.col("n") == 1, single).otherwise(many)).alias("drafts"))


def dependency_signal_rows(manifests: DataFrame) -> DataFrame:
    d, at = F.col("dependency"), F.col("path")
    hits = dependency_technologies(manifests)
    per_manifest = 1_000_000
    item = E.draft("observed", "technology",
                   F.concat(T.code_span(at), F.lit(" declares "), T.code_span(d), F.lit(" in its "), F.col("section"), F.lit(".")),
                   kind="file", path=at, section=F.col("section"))
    declared = hits.select(
        "repo_id", (F.lit(1000) + F.col("manifest_pos") * per_manifest + F.col("dep_pos")).cast("long").alias("ord"), "name", "kind",
        F.lit("observed").alias("level"), F.concat(T.code_span(d), F.lit(" in "), T.code_span(at), F.lit(" "), F.col("section")).alias("basis"),
        E.drafts(item).alias("drafts"))
    target = F.try_element_at("details", F.lit("targetFramework"))
    targets = manifests.filter(target.isNotNull()).select(
        "repo_id", (F.lit(1000) + F.col("manifest_pos") * per_manifest + (per_manifest - 1)).cast("long").alias("ord"),
        F.lit(".NET").alias("name"), F.lit("platform").alias("kind"), F.lit("observed").alias("level"),
        F.concat(F.lit("targets "), T.code_span(target), F.lit(" in "), T.code_span(at)).alias("basis"),
        E.drafts(E.draft("observed", "technology", F.concat(T.code_span(at), F.lit(" targets "), T.code_span(target), F.lit(".")),
                         kind="file", path=at)).alias("drafts"))
    return declared.unionByName(targets)


def signals(files: DataFrame, manifests: DataFrame) -> DataFrame:
    parts = [language_signal_rows(files), marker_signal_rows(files), dependency_signal_rows(manifests)]
    return reduce(DataFrame.unionByName, parts).select(*SIGNAL_COLUMNS)


def technologies(signal_rows: DataFrame) -> DataFrame:
    """Signals of one name merged: strongest level, best kind, distinct bases in order.

    At most 200 manifests per repository are read, so the list folded per name is bounded.
    """
    rank = lambda values, column: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    merged = signal_rows.groupBy("repo_id", "name").agg(
        F.min("ord").alias("ord"),
        F.min(rank(rules.TECHNOLOGY_KIND_ORDER, "kind")).alias("kind_rank"),
        F.min(rank(rules.EVIDENCE_LEVELS, "level")).alias("level_rank"),
        F.array_sort(F.collect_list(F.struct("ord", "basis", "drafts"))).alias("parts"))
    basis = F.aggregate(
        "parts", F.lit(""), lambda acc, p: F.when(acc == "", p["basis"]).when(acc.contains(p["basis"]), acc).otherwise(F.concat(acc, F.lit("; "), p["basis"])))
    pick = lambda values, column: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(column).cast("int"))
    order = Window.partitionBy("repo_id").orderBy("kind_rank", "ord")  # one row per known technology
    return merged.select(
        "repo_id", "name", pick(rules.TECHNOLOGY_KIND_ORDER, "kind_rank").alias("kind"), pick(rules.EVIDENCE_LEVELS, "level_rank").alias("level"),
        basis.alias("basis"), F.row_number().over(order).cast("long").alias("pos"),
        F.flatten(F.transform("parts", lambda p: p["drafts"])).alias("drafts"))


# ---------------------------------------------------------------------- history of markers
def marker_history(commits: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """Per tool: first addition, last removal, presence at HEAD.

    Every distinct path is matched once, and only paths that match are joined; the few commits
    kept are joined afterwards for their names and dates.
    """
    facts = path_facts(changes, ["path", "previous_path"], {"markers": matching_markers, "vendored": P.is_vendored})
    facts = facts.filter("vendored or size(markers) > 0")
    own = join_facts(changes.select("repo_id", "sha", "seq", "pos", "path", "previous_path", "status"), facts, "path").filter("vendored is null or not vendored")
    own = join_facts(own, facts.select("known_path", "markers"), "previous_path", "old_")
    none = F.array().cast("array<int>")
    status, now, before = F.col("status"), F.coalesce("markers", none), F.coalesce("old_markers", none)
    added = F.when(status.isin("added", "renamed", "copied"), F.array_except(now, before))
    removed = F.when(status == "deleted", now).when(status == "renamed", F.array_except(before, now))
    events = own.withColumns({"added": F.coalesce(added, none), "removed": F.coalesce(removed, none)}).filter(
        (F.size("added") > 0) | (F.size("removed") > 0))
    tagged = events.select(
        "repo_id", "sha", "seq", "pos", "path", "previous_path", "status",
        F.explode(F.concat(
            F.transform("added", lambda m: F.struct(m.alias("marker_pos"), F.lit(True).alias("is_added"))),
            F.transform("removed", lambda m: F.struct(m.alias("marker_pos"), F.lit(False).alias("is_added"))))).alias("e"))
    old_path = F.when((F.col("status") == "renamed") & F.col("previous_path").isNotNull(), F.col("previous_path")).otherwise(F.col("path"))
    order, is_added = F.struct("seq", "pos"), F.col("e.is_added")
    history = tagged.groupBy("repo_id", F.col("e.marker_pos").alias("marker_pos")).agg(
        F.min_by(F.struct("seq", "sha", "path"), F.when(is_added, order)).alias("a"),
        F.max_by(F.struct("seq", "sha", old_path.alias("path")), F.when(~is_added, order)).alias("r"),
        F.bool_or(is_added).alias("has_a"), F.bool_or(~is_added).alias("has_r"))
    present = marker_matches(files).select("repo_id", "marker_pos").distinct().withColumn("present", F.lit(True))
    rows = _described(history, None).join(present, ["repo_id", "marker_pos"], "left")
    a, r = F.col("has_a"), F.col("has_r")
    # a row per tool and repository, written: the commits named there are picked without a shuffle of all commits
    flat = stage(rows.select(
        "repo_id", "marker_pos", "tool", "tool_group", F.coalesce("present", F.lit(False)).alias("present"),
        *[F.when(a, F.col(f"a.{c}")).alias(f"added_{c}") for c in ("seq", "sha", "path")],
        *[F.when(r, F.col(f"r.{c}")).alias(f"removed_{c}") for c in ("seq", "sha", "path")]))
    sides = flat.select("repo_id", F.col("added_sha").alias("sha")).union(flat.select("repo_id", F.col("removed_sha").alias("sha")))
    wanted = stage(sides.distinct())
    named = stage(commits.select("repo_id", "sha", "short_sha", "authored_date").join(wanted, ["repo_id", "sha"], "left_semi"))
    names = lambda side: named.select("repo_id", F.col("sha").alias(f"{side}_sha"), F.col("short_sha").alias(f"{side}_short"),
                                        F.col("authored_date").alias(f"{side}_date"))
    return flat.join(names("added"), ["repo_id", "added_sha"], "left").join(names("removed"), ["repo_id", "removed_sha"], "left")


def tool_migrations(history: DataFrame) -> DataFrame:
    """A removed tool and the alternative that appeared within three commits of its removal."""
    gone = history.filter("removed_seq is not null and not present")
    new = history.filter("present and added_seq is not null and tool_group is not null")
    g, n = gone.alias("g"), new.alias("n")
    near = F.abs(F.col("n.added_seq") - F.col("g.removed_seq")) <= rules.MIGRATION_DISTANCE
    pairs = g.join(n, (F.col("g.repo_id") == F.col("n.repo_id")) & (F.col("g.tool_group") == F.col("n.tool_group"))
                   & (F.col("g.marker_pos") != F.col("n.marker_pos")) & near)
    fields = ["tool", "marker_pos", "added_seq", "added_sha", "added_path", "added_short", "added_date"]
    return pairs.groupBy(
        F.col("g.repo_id").alias("repo_id"), F.col("g.marker_pos").alias("from_pos"), F.col("g.tool").alias("from_tool"),
        *[F.col(f"g.removed_{c}").alias(f"removed_{c}") for c in ("seq", "sha", "path", "short", "date")],
    ).agg(F.min_by(F.struct(*[F.col(f"n.{f}").alias(f) for f in fields]), F.col("n.marker_pos")).alias("to")).select(
        "repo_id", "from_pos", "from_tool", "removed_seq", "removed_sha", "removed_path", "removed_short", "removed_date",
        F.col("to.tool").alias("to_tool"), F.col("to.marker_pos").alias("to_pos"), *[F.col(f"to.{f}").alias(f) for f in fields[2:]])


def tool_events(history: DataFrame, migrations: DataFrame) -> DataFrame:
    """Tools adopted after the first commit, or given up without a replacement."""
    replaced = migrations.select("repo_id", F.col("from_pos").alias("marker_pos"))
    replacing = migrations.select("repo_id", F.col("to_pos").alias("marker_pos")).distinct()
    stopped = history.filter("removed_seq is not null and not present").join(replaced, ["repo_id", "marker_pos"], "left_anti")
    adopted = history.filter("present and added_seq > 0").join(replacing, ["repo_id", "marker_pos"], "left_anti")
    return stopped.select("repo_id", "tool", F.lit("stopped").alias("event"), F.col("removed_seq").alias("idx"), F.lit(0).alias("phase"), "marker_pos",
                          F.col("removed_sha").alias("sha"), F.col("removed_short").alias("short"), F.col("removed_date").alias("date"), F.col("removed_path").alias("path")
                          ).unionByName(
        adopted.select("repo_id", "tool", F.lit("adopted").alias("event"), F.col("added_seq").alias("idx"), F.lit(1).alias("phase"), "marker_pos",
                       F.col("added_sha").alias("sha"), F.col("added_short").alias("short"), F.col("added_date").alias("date"), F.col("added_path").alias("path")))


def tooling_decisions(history: DataFrame) -> DataFrame:
    """At most ten inferred decisions per repository, by position, removals before adoptions."""
    migrations = tool_migrations(history)
    seen = lambda side, verb, path, sha, short, date: E.draft(
        "observed", "history", F.concat(T.code_span(path), F.lit(f" was {verb} in this commit.")),
        kind="commit", sha=F.col(sha), short_sha=F.col(short), date=F.col(date), files=F.array(F.col(path)))
    moved = migrations.select(
        "repo_id", F.least("removed_seq", "added_seq").alias("idx"), F.lit(0).alias("phase"), F.col("from_pos").alias("marker_pos"),
        F.concat(F.lit("Moved from "), F.col("from_tool"), F.lit(" to "), F.col("to_tool")).alias("title"),
        F.concat(T.code_span("removed_path"), F.lit(" was removed in "), T.code_span("removed_short"), F.lit(" and "),
                 T.code_span("added_path"), F.lit(" was added in "), T.code_span("added_short")).alias("basis"),
        F.col("added_date").alias("date"),
        E.drafts(seen("r", "removed", "removed_path", "removed_sha", "removed_short", "removed_date"),
                 seen("a", "added", "added_path", "added_sha", "added_short", "added_date")).alias("drafts"))
    events = tool_events(history, migrations)
    stopped = F.col("event") == "stopped"
    basis = F.when(stopped, F.concat(T.code_span("path"), F.lit(" was removed in "), T.code_span("short"), F.lit(" and no "), F.col("tool"), F.lit(" files remain at HEAD"))).otherwise(
        F.concat(T.code_span("path"), F.lit(" first appeared in "), T.code_span("short"), F.lit(", "), F.col("idx"), F.lit(" commit"), T.plural_suffix("idx"),
                 F.lit(" after the first analyzed commit")))
    single = events.select(
        "repo_id", "idx", "phase", "marker_pos",
        F.concat(F.when(stopped, "Stopped using ").otherwise("Adopted "), F.col("tool")).alias("title"), basis.alias("basis"), "date",
        E.drafts(F.when(stopped, seen("r", "removed", "path", "sha", "short", "date")).otherwise(seen("a", "added", "path", "sha", "short", "date"))).alias("drafts"))
    order = [F.col("idx"), F.col("phase"), F.col("marker_pos")]
    return ranking.first_rows(moved.unionByName(single), ["repo_id"], order, rules.MAX_TOOLING_DECISIONS)
