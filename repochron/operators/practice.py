"""Engineering practice: facts per repository and the findings worded from them.

Each ``*_findings`` frame has (repo_id, area, ord, text, level, drafts).  ``ord`` places
findings in reading order: testing, scripts, CI, types, linting, benchmarks,
documentation, releases, process.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commands as S
from repochron.functions import commits as C
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import ci as CI
from repochron.operators import evidence as E
from repochron.operators import manifests as M
from repochron.operators import ranking
from repochron.operators import technology as X
from repochron.session import stage

FINDING = ["repo_id", "area", "ord", "text", "level", "drafts"]
STEP = 10_000_000


def _finding(df: DataFrame, area, ordinal, text: Column, *drafts: Column, level: str = "observed") -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("repo_id", lit(area).alias("area"), lit(ordinal).cast("long").alias("ord"), text.alias("text"),
                     F.lit(level).alias("level"), E.drafts(*drafts).alias("drafts"))


def _sampled(df: DataFrame, k: int, column: str = "path") -> DataFrame:
    """(repo_id, n, paths): how many, and the first ``k`` in file order."""
    totals = df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    first = ranking.first_rows(df.select("repo_id", column), ["repo_id"], [F.col(column)], k).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(column)).alias("paths"))
    return totals.join(first, "repo_id")


def own_files(files: DataFrame) -> DataFrame:
    return files.filter(~P.is_vendored("path"))


# ---------------------------------------------------------------------- commit practice
def commit_practice(people: DataFrame, summaries: DataFrame) -> DataFrame:
    """Shares over non-merge commits by people, with the ends of the range."""
    work = people.filter(~F.col("is_merge"))
    has_body = F.length(T.trim("body")) >= 20
    seq = F.col("seq")
    totals = work.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.col("source") == "conventional").alias("conventional"),
        F.count_if(has_body).alias("with_body"), F.min_by("sha", seq).alias("first_sha"), F.max_by("sha", seq).alias("last_sha"))
    sample = ranking.first_rows(work.filter(has_body).select("repo_id", "seq", "short_sha"), ["repo_id"], [seq], 20).groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "short_sha"))), lambda s: s["short_sha"]).alias("body_sample"))
    noun = summaries.groupBy("repo_id").agg(
        F.when(F.bool_or("automated"), "non-merge commits by people").otherwise("non-merge commits").alias("noun"))
    return totals.join(sample, "repo_id", "left").join(noun, "repo_id")


def conventional_share(practice: DataFrame) -> DataFrame:
    share = F.col("conventional") / F.col("commits")
    return practice.withColumn("share", share).withColumn("is_finding", (F.col("commits") >= 3) & (share >= 0.5))


def message_body_share(practice: DataFrame) -> DataFrame:
    share = F.col("with_body") / F.col("commits")
    return practice.withColumn("share", share).withColumn("is_finding", (F.col("commits") >= 3) & (share >= 0.25))


def process_findings(practice: DataFrame) -> DataFrame:
    of = F.concat(F.lit(" of "), T.format_count("commits"), F.lit(" "), F.col("noun"))
    span = dict(kind="commit-range", first_sha=F.col("first_sha"), last_sha=F.col("last_sha"), count=F.col("commits"))
    labeled = F.concat(T.format_count("conventional"), of)
    percent = F.floor(F.col("share") * 100 + 0.5)
    conventional = _finding(
        conventional_share(practice).filter("is_finding"), "process", 9 * STEP,
        F.concat(labeled, F.lit(" ("), percent, F.lit("%) use Conventional Commits prefixes.")),
        E.draft("observed", "history", F.concat(labeled, F.lit(" use a Conventional Commits prefix.")), **span))
    explained = F.concat(T.format_count("with_body"), of, F.lit(" include a message body"))
    bodies = _finding(
        message_body_share(practice).filter("is_finding"), "process", 9 * STEP + 1, F.concat(explained, F.lit(" describing the change.")),
        E.draft("observed", "history", F.concat(explained, F.lit(".")), commits=F.col("body_sample"), **span))
    return conventional.unionByName(bodies)


# ---------------------------------------------------------------------- testing
def test_touching_commits(people: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits that touched test sources: number, ends, ordinal and first test file.

    The ordinal is the count of non-merge commits up to the first one, so nothing is
    numbered: only the first touching commit per repository is looked up.
    """
    work = people.filter(~F.col("is_merge"))
    seq, hit = F.col("seq"), F.col("test_commit")
    who = F.struct("seq", "sha", "short_sha", "authored_date")
    totals = work.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(hit).alias("touching"),
        F.min_by(who, F.when(hit, seq)).alias("f"), F.max_by("sha", F.when(hit, seq)).alias("last_sha")).filter("touching > 0")
    # one row per repository, written: neither commits nor changes are shuffled for it
    firsts = stage(totals.select("repo_id", F.col("f.seq").alias("first_seq"), F.col("f.sha").alias("sha")))
    ordinal = work.join(firsts.drop("sha"), "repo_id").groupBy("repo_id").agg(F.count_if(seq <= F.col("first_seq")).alias("ordinal"))
    # inside the aggregate, as a filter would test the paths of all changes ahead of the join
    path = changes.join(firsts, ["repo_id", "sha"]).groupBy("repo_id").agg(F.min_by("path", F.when(P.is_test_source("path"), F.col("pos"))).alias("first_path"))
    sample = ranking.first_rows(work.filter(hit).select("repo_id", "seq", "short_sha"), ["repo_id"], [seq], 20).groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "short_sha"))), lambda s: s["short_sha"]).alias("sample"))
    return totals.join(ordinal, "repo_id").join(path, "repo_id", "left").join(sample, "repo_id").select(
        "repo_id", "commits", "touching", F.col("f.sha").alias("first_sha"), F.col("f.short_sha").alias("first_short"),
        F.col("f.authored_date").alias("first_date"), "last_sha", "ordinal", "first_path", "sample")


def inventory(files: DataFrame) -> DataFrame:
    """Test, CI, documentation and benchmark files at HEAD with samples of each."""
    own = own_files(files)
    totals = own.groupBy("repo_id").agg(
        F.count_if(P.is_test_source("path")).alias("test_files"), F.count_if(P.ci_system("path").isNotNull()).alias("ci_files"),
        F.count_if(P.is_documentation("path")).alias("documentation_files"), F.count_if(P.is_benchmark("path")).alias("benchmark_files"),
        F.bool_or(F.col("path").endswith(".rs")).alias("rust_caveat"))
    tests = _sampled(own.filter(P.is_test_source("path")), 12).select("repo_id", F.col("paths").alias("test_sample"))
    benches = _sampled(own.filter(P.is_benchmark("path")), 10).select("repo_id", F.col("paths").alias("benchmark_sample"))
    return totals.join(tests, "repo_id", "left").join(benches, "repo_id", "left")


def testing_findings(inventory_rows: DataFrame, touching: DataFrame, practice: DataFrame) -> DataFrame:
    n, rust = F.col("test_files"), F.col("rust_caveat")
    have = inventory_rows.filter("test_files > 0")
    caveat = F.when(rust, " Rust unit tests written inside source files are not counted, because source code is not read.").otherwise("")
    counted = _finding(
        have, "testing", STEP,
        F.concat(F.lit("Repository contains "), T.format_count(n), F.lit(" "), F.when(rust, "separate ").otherwise(""), F.lit("test file"), T.plural_suffix(n), F.lit("."), caveat),
        E.draft("observed", "testing", F.concat(T.format_count(n), F.lit(" test file"), T.plural_suffix(n), F.lit(" tracked at HEAD.")), kind="file-set",
                description="Test files at HEAD (by naming convention and test directories)", total=n, paths=F.col("test_sample")))
    history = touching.join(have.select("repo_id", "rust_caveat"), "repo_id").join(practice.select("repo_id", "noun"), "repo_id").filter("commits > 1")
    share = F.concat(T.format_count("touching"), F.lit(" of "), T.format_count("commits"), F.lit(" "), F.col("noun"))
    modified = _finding(
        history, "testing", STEP + 1, F.concat(F.when(rust, "Separate test files").otherwise("Test files"), F.lit(" were changed in "), share, F.lit(".")),
        E.draft("observed", "testing", F.concat(share, F.lit(" modified test files.")), kind="commit-range", first_sha=F.col("first_sha"),
                last_sha=F.col("last_sha"), count=F.col("touching"), commits=F.col("sample")))
    path = F.col("first_path")
    when = F.when(F.col("ordinal") == 1, "in the first commit").otherwise(F.concat(F.lit("in commit "), F.col("ordinal"), F.lit(" of "), T.format_count("commits")))
    first = _finding(
        history.filter("first_path is not null"), "testing", STEP + 2,
        F.concat(F.lit("The first test file, "), T.code_span(path), F.lit(", was added "), when, F.lit(" ("), T.code_span("first_short"), F.lit(").")),
        E.draft("observed", "testing", F.concat(F.lit("First test file "), T.code_span(path), F.lit(" added.")), kind="commit", sha=F.col("first_sha"),
                short_sha=F.col("first_short"), date=F.col("first_date"), files=F.array(path)))
    return counted.unionByName(modified).unionByName(first)


# ---------------------------------------------------------------------- package scripts
SCRIPT_AREAS = {"test": "testing", "typecheck": "types", "lint": "linting", "format": "linting", "build": "build", "benchmark": "benchmarks"}


def package_scripts(manifests: DataFrame) -> DataFrame:
    """Scripts of the root manifest that serve a purpose, with the area they belong to."""
    rows = manifests.filter("is_root").select("repo_id", "path", "scripts", F.posexplode("script_order").alias("pos", "name"))
    named = rows.withColumn("command", F.element_at("scripts", F.col("name")))
    purposes = F.filter("purposes", lambda p: p != "audit")
    areas = F.create_map(*[F.lit(v) for pair in SCRIPT_AREAS.items() for v in pair])
    first = F.try_element_at(F.filter("purposes", lambda p: F.map_contains_key(areas, p)), F.lit(1))
    return CI.with_purposes(named).withColumn("purposes", purposes).withColumn("area", F.try_element_at(areas, first)).filter(
        "area is not null").select("repo_id", "path", F.col("pos").cast("long").alias("pos"), "name", "command", "purposes", "area")


def _labels(purposes) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.PURPOSE_LABELS.items() for v in pair])
    return F.transform(purposes, lambda p: F.element_at(table, p))


def script_findings(manifests: DataFrame) -> DataFrame:
    scripts = package_scripts(manifests)
    at, name, command = T.code_span("path"), F.col("name"), F.col("command")
    category = F.when(F.col("area") == "testing", "testing").when(F.col("area") == "build", "build").otherwise("quality")
    defined = _finding(
        scripts, F.col("area"), F.lit(2 * STEP) + F.col("pos"),
        F.concat(at, F.lit(" defines a "), T.code_span(name), F.lit(" script for "), T.join_words(_labels("purposes")), F.lit(": "), T.code_span(command), F.lit(".")),
        E.draft("observed", category, F.concat(at, F.lit(" script "), T.code_span(name), F.lit(" runs "), T.code_span(command), F.lit(".")),
                kind="file", path=F.col("path"), section="scripts", excerpt=F.concat(F.lit('"'), name, F.lit('": "'), command, F.lit('"'))))
    binaries = manifests.filter("is_root").filter(F.size("binaries") > 0)
    listed = F.array_join(F.transform("binaries", T.code_span), ", ")
    many = F.size("binaries") > 1
    exposed = _finding(
        binaries, "build", 3 * STEP - 1,
        F.concat(F.lit("The package exposes "), F.when(many, "executables").otherwise("an executable"), F.lit(": "), listed, F.lit(".")),
        E.draft("observed", "build", F.concat(at, F.lit(" declares executable"), F.when(many, "s").otherwise(""), F.lit(" "), listed, F.lit(".")),
                kind="file", path=F.col("path"), section="bin"))
    return defined.unionByName(exposed)


# ---------------------------------------------------------------------- continuous integration
def ci_positions(configurations: DataFrame) -> DataFrame:
    """Configurations in path order; at most 200 documents per repository are read."""
    order = Window.partitionBy("repo_id").orderBy(T.locale_key("path"), "path")
    return configurations.withColumn("ci_pos", F.row_number().over(order))


def ci_purposeful_steps(steps: DataFrame) -> DataFrame:
    """Per configuration the first six distinct purposeful commands, worded."""
    purposeful = steps.filter(F.size("purposes") > 0)
    distinct = ranking.first_rows(CI.distinct_commands(purposeful), ["repo_id", "path"], [F.col("pos")], 6)
    shown = F.filter("purposes", lambda p: (p != "coverage") | (F.size("purposes") == 1))
    via = F.when(F.col("script_command").isNotNull(), F.concat(F.lit(" (script: "), T.code_span("script_command"), F.lit(")"))).otherwise("")
    words = F.concat(T.code_span("command"), via, F.lit(" for "), T.join_words(_labels(shown)))
    grouped = distinct.groupBy("repo_id", "path", "system").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", words.alias("w")))), lambda s: s["w"]).alias("described"))
    all_commands = purposeful.groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line", "command"))).alias("all"))
    return grouped.join(all_commands, ["repo_id", "path"]).select(
        "repo_id", "path", "system", "described", F.col("all")[0]["line"].alias("first_line"),
        F.transform("all", lambda s: s["command"]).alias("commands"))


def ci_unrecognized(configurations: DataFrame) -> DataFrame:
    """Configurations without a purposeful command: number, total, paths in order."""
    return ci_positions(configurations).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("configurations"), F.count_if(F.col("purposeful") == 0).alias("unrecognized"),
        F.array_sort(F.collect_list(F.when(F.col("purposeful") == 0, F.struct("ci_pos", "path")))).alias("paths")
    ).select("repo_id", "configurations", "unrecognized", F.transform("paths", lambda p: p["path"]).alias("paths"))


def ci_findings(configurations: DataFrame, steps: DataFrame) -> DataFrame:
    placed = ci_positions(configurations)
    summary = ci_unrecognized(configurations)
    base = F.lit(3 * STEP) + F.col("ci_pos")
    named = F.concat(F.col("system"), F.lit(" configuration "), T.code_span("path"))
    runs = F.concat(F.col("system"), F.lit(" configuration runs "), F.array_join(F.transform("commands", T.code_span), ", "), F.lit("."))
    purposeful = _finding(
        placed.select("repo_id", "path", "ci_pos").join(ci_purposeful_steps(steps), ["repo_id", "path"]), "ci", base,
        F.concat(named, F.lit(" includes steps running "), T.join_words("described"), F.lit(".")),
        E.draft("observed", "ci", runs, kind="file", path=F.col("path"), line=F.col("first_line"), excerpt=F.array_join("commands", "\n")))
    alone = placed.filter("purposeful = 0").join(summary.filter("unrecognized = 1").select("repo_id"), "repo_id", "left_semi")
    kept = CI.distinct_commands(steps).filter(~S.is_plumbing("command")).groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line", "command"))).alias("all"))
    lone = alone.join(kept, ["repo_id", "path"], "left").withColumns({
        "commands": F.transform("all", lambda s: s["command"]), "first_line": F.try_element_at("all", F.lit(1))["line"]})
    shown = F.transform(F.slice("commands", 1, 3), lambda c: T.code_span(T.truncate(c, 80)))
    more = F.when(F.size("commands") > 3, F.concat(F.lit(" and "), F.size("commands") - 3, F.lit(" more"))).otherwise("")
    has = F.col("commands").isNotNull()
    single = _finding(
        lone, "ci", base,
        F.when(has, F.concat(named, F.lit(" includes steps running "), T.join_words(shown), more, F.lit("; none are recognized as tests, linting, or builds.")))
        .otherwise(F.concat(named, F.lit(" is tracked; the commands it runs could not be found."))),
        E.draft("observed", "ci", F.when(has, runs).otherwise(F.concat(F.col("system"), F.lit(" configuration is tracked."))),
                kind="file", path=F.col("path"), line=F.col("first_line"), excerpt=F.array_join("commands", "\n")))
    n = F.col("unrecognized")
    first_four = F.transform(F.slice("paths", 1, 4), T.code_span)
    words = F.when(n > 4, F.array_append(first_four, F.concat(n - 4, F.lit(" more")))).otherwise(first_four)
    grouped = _finding(
        summary.filter("unrecognized >= 2"), "ci", 4 * STEP - 1,
        F.concat(T.format_count(n), F.when(n < F.col("configurations"), " other").otherwise(""),
                 F.lit(" CI configurations, such as release or maintenance workflows, run no step recognized as tests, linting, or builds: "), T.join_words(words), F.lit(".")),
        E.draft("observed", "ci", F.concat(n, F.lit(" CI configurations run no command recognized as tests, linting, or builds.")), kind="file-set",
                description="CI configurations without recognized test, lint, or build steps", total=n, paths=F.col("paths")))
    return purposeful.unionByName(single).unionByName(grouped)


# ---------------------------------------------------------------------- types, lint, benchmarks
def type_check_configuration(documents: DataFrame) -> DataFrame:
    """Strict compiler flags set to true in the root tsconfig, in fixed order, with the line of "strict"."""
    root = documents.filter(F.col("path") == "tsconfig.json").withColumn("v", F.try_parse_json(M.strip_json_comments("text")))
    node = lambda f: F.try_variant_get("v", f"$.compilerOptions.{f}", "variant")
    on = [F.when((F.schema_of_variant(node(f)) == "BOOLEAN") & F.try_variant_get("v", f"$.compilerOptions.{f}", "boolean"), F.lit(f)) for f in rules.STRICT_FLAGS]
    before = F.regexp_extract(T.unix_lines("text"), r'^([\s\S]*?)[^\n]*"strict"\s*:', 1)
    found = F.col("text").rlike(r'"strict"\s*:')
    line = F.when(found, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
    return root.select("repo_id", F.array_compact(F.array(*on)).alias("flags"), line.cast("long").alias("line")).filter(F.size("flags") > 0)


def type_findings(documents: DataFrame, manifests: DataFrame) -> DataFrame:
    flags = F.col("flags")
    extra = F.transform(F.filter(flags, lambda f: f != "strict"), T.code_span)
    strict = F.array_contains(flags, "strict")
    text = F.when(strict, F.concat(F.lit("`tsconfig.json` enables TypeScript `strict` mode"),
                                   F.when(F.size(extra) > 0, F.concat(F.lit(" plus "), T.join_words(extra))).otherwise(""), F.lit("."))).otherwise(
        F.concat(F.lit("`tsconfig.json` enables "), T.join_words(extra), F.lit(".")))
    compiler = _finding(
        type_check_configuration(documents), "types", 4 * STEP, text,
        E.draft("observed", "quality", F.concat(F.lit("`tsconfig.json` enables "), F.array_join(F.transform(flags, T.code_span), ", "), F.lit(".")),
                kind="file", path="tsconfig.json", section="compilerOptions", line=F.col("line")))
    tools = manifests.select("repo_id", "path", "manifest_pos", "details", F.posexplode(F.array(F.lit("mypy"), F.lit("pyright"))).alias("i", "tool"))
    section = F.concat(F.lit("tool."), F.col("tool"))
    checkers = _finding(
        tools.filter(F.map_contains_key("details", section)), "types", F.lit(4 * STEP + 10) + F.col("manifest_pos") * 2 + F.col("i"),
        F.concat(T.code_span("path"), F.lit(" includes "), F.col("tool"), F.lit(" configuration.")),
        E.draft("observed", "quality", F.concat(T.code_span("path"), F.lit(" configures "), F.col("tool"), F.lit(".")), kind="file", path=F.col("path"), section=section))
    return compiler.unionByName(checkers)


def lint_configuration(files: DataFrame) -> DataFrame:
    """First file per lint or formatting tool, in marker order."""
    hits = X.marker_matches(files).filter(F.col("tool").isin(*rules.LINT_TOOLS))
    first = hits.groupBy("repo_id", "tool", "marker_pos").agg(F.min("path").alias("path"))
    return first.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("marker_pos", "tool", "path"))).alias("tools"))


def lint_findings(files: DataFrame) -> DataFrame:
    rows = lint_configuration(files)
    named = F.transform("tools", lambda t: F.concat(t["tool"], F.lit(" ("), T.code_span(t["path"]), F.lit(")")))
    paths = F.transform("tools", lambda t: t["path"])
    return _finding(
        rows, "linting", 5 * STEP, F.concat(F.lit("Lint and formatting configuration is tracked for "), T.join_words(named), F.lit(".")),
        E.draft("observed", "quality", F.concat(F.lit("Lint and formatting configuration tracked: "), F.array_join(F.transform(paths, T.code_span), ", "), F.lit(".")),
                kind="file-set", description="Lint and formatting configuration files", total=F.size("tools"), paths=paths))


def benchmark_findings(inventory_rows: DataFrame) -> DataFrame:
    n = F.col("benchmark_files")
    counted = F.concat(n, F.lit(" benchmark file"), T.plural_suffix(n))
    return _finding(
        inventory_rows.filter("benchmark_files > 0"), "benchmarks", 6 * STEP, F.concat(F.lit("Repository contains "), counted, F.lit(".")),
        E.draft("observed", "quality", F.concat(counted, F.lit(" tracked.")), kind="file-set", description="Benchmark files", total=n, paths=F.col("benchmark_sample")))


# ---------------------------------------------------------------------- documentation
def documentation_roles(files: DataFrame) -> DataFrame:
    """Own documentation-related files with exactly one role each, and the README of each repository.

    Roles: readme (the first root README), record, guide, assistant, other.
    """
    own = own_files(files).select("repo_id", "path")
    readme = own.filter(P.is_readme("path")).groupBy("repo_id").agg(F.min("path").alias("readme"))
    placed = own.join(readme, "repo_id", "left")
    is_doc = P.is_documentation("path")
    is_guide = P.guide_label("path").isNotNull()
    is_assistant = ~F.col("path").contains("/") & P.is_assistant_guide("path")
    role = F.coalesce(
        F.when(is_guide, "guide"), F.when(is_assistant, "assistant"), F.when(P.is_decision_record("path"), "record"),
        F.when(F.col("path") == F.coalesce("readme", F.lit("")), "readme"), F.when(is_doc, "other"))
    return placed.select("repo_id", "path", role.alias("role"), P.guide_label("path").alias("label")).filter("role is not null")


def other_documentation(files: DataFrame) -> DataFrame:
    return documentation_roles(files).filter("role = 'other'").select("repo_id", "path")


def documentation_findings(files: DataFrame, sections: DataFrame) -> DataFrame:
    roles = documentation_roles(files)
    readme = roles.filter("role = 'readme'").select("repo_id", "path")
    headings = sections.filter("level = 2").join(readme, ["repo_id", "path"], "left_semi").groupBy("repo_id", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("headings"))
    read = sections.join(readme, ["repo_id", "path"], "left_semi").select("repo_id", "path").distinct().join(headings, ["repo_id", "path"], "left")
    at, titles = T.code_span("path"), F.coalesce("headings", F.array().cast("array<string>"))
    shown = F.transform(F.slice(titles, 1, 10), lambda h: F.concat(F.lit("“"), h, F.lit("”")))
    tracked = F.concat(at, F.lit(" is tracked."))
    has = F.size(titles) > 0
    organized = _finding(
        read, "documentation", 7 * STEP, F.when(has, F.concat(at, F.lit(" is organized into "), F.size(titles), F.lit(" sections, including "), T.join_words(shown), F.lit("."))).otherwise(tracked),
        E.draft("observed", "documentation", F.when(has, F.concat(at, F.lit(" has sections: "), F.array_join(titles, "; "), F.lit("."))).otherwise(tracked), kind="file", path=F.col("path")))
    n = F.col("n")
    records = _sampled(own_files(files).filter(P.is_decision_record("path")), 10)
    counted = F.concat(n, F.lit(" architecture decision record"), T.plural_suffix(n))
    recorded = _finding(
        records, "documentation", 7 * STEP + 1, F.concat(F.lit("Repository contains "), counted, F.lit(".")),
        E.draft("observed", "documentation", F.concat(counted, F.lit(" tracked.")), kind="file-set", description="Architecture decision records", total=n, paths=F.col("paths")))
    beyond = roles.filter(F.col("role").isin("guide", "assistant", "other"))
    rank = F.when(F.col("role") == "guide", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    totals = beyond.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "other").alias("others"))
    sample = ranking.first_rows(beyond, ["repo_id"], [rank, F.col("path")], 12, "r").groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]).alias("paths"))
    # Guides sit at most one directory deep and assistant guides at the root: few per repository.
    named = beyond.filter("role <> 'other'").groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "guide", F.struct("path", "label")))).alias("guides"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("path")))).alias("assistants"))
    guides = F.transform(F.coalesce("guides", F.array().cast("array<struct<path:string,label:string>>")), lambda g: F.concat(g["label"], F.lit(" ("), T.code_span(g["path"]), F.lit(")")))
    assistants = F.when(F.size("assistants") > 0, F.concat(F.lit("instructions for AI coding assistants ("), F.array_join(F.transform("assistants", T.code_span), ", "), F.lit(")")))
    others = F.when(F.col("others") > 0, F.concat(F.col("others"), F.lit(" other documentation file"), T.plural_suffix("others")))
    parts = F.concat(guides, F.array_compact(F.array(assistants, others)))
    includes = _finding(
        totals.join(sample, "repo_id").join(named, "repo_id", "left"), "documentation", 7 * STEP + 2,
        F.concat(F.lit("Beyond the README, the repository includes "), T.join_words(parts), F.lit(".")),
        E.draft("observed", "documentation", F.concat(F.lit("Documentation files tracked: "), n, F.lit(".")), kind="file-set",
                description="Documentation files other than the README", total=n, paths=F.col("paths")))
    return organized.unionByName(recorded).unionByName(includes)


# ---------------------------------------------------------------------- releases
def tag_draft(name: Column, sha: Column) -> Column:
    return E.draft("observed", "history", F.concat(F.lit("Tag "), T.code_span(name), F.lit(" points at "), T.code_span(F.substring(sha, 1, 7)), F.lit(".")),
                   kind="tag", name=name, sha=sha)


def release_span(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """Number of tags and project releases, with the first and last by history."""
    placed = tags.join(commits.select("repo_id", "sha", "seq"), ["repo_id", "sha"]).withColumn("weight", C.release_weight("name"))
    release = F.col("weight") > 0
    order, who = F.struct("seq", "pos"), F.struct("name", "sha")
    rows = placed.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("tags"), F.count_if(release).alias("releases"),
        F.min_by(who, F.when(release, order)).alias("fr"), F.max_by(who, F.when(release, order)).alias("lr"),
        F.min_by(who, order).alias("fa"), F.max_by(who, order).alias("la"))
    has = F.col("releases") > 0
    first, last = F.when(has, F.col("fr")).otherwise(F.col("fa")), F.when(has, F.col("lr")).otherwise(F.col("la"))
    return rows.select("repo_id", "tags", "releases", first["name"].alias("first_tag"), first["sha"].alias("first_sha"),
                       last["name"].alias("last_tag"), last["sha"].alias("last_sha"))


def release_findings(span: DataFrame) -> DataFrame:
    first, last = T.code_span("first_tag"), T.code_span("last_tag")
    others = F.col("tags") - F.col("releases")
    total = F.concat(F.lit("History includes "), T.format_count("tags"), F.lit(" tags"))
    text = (
        F.when(F.col("tags") == 1, F.concat(F.lit("History includes one tag, "), first, F.lit(".")))
        .when((F.col("releases") > 0) & (others > 0), F.concat(
            total, F.lit(": "), T.format_count("releases"), F.lit(" project release"), T.plural_suffix("releases"), F.lit(" from "), first, F.lit(" to "), last,
            F.lit(", and "), T.format_count(others), F.lit(" other tag"), T.plural_suffix(others), F.lit(", such as component releases.")))
        .otherwise(F.concat(total, F.lit(", from "), first, F.lit(" to "), last, F.lit("."))))
    end = F.when(F.col("first_tag") != F.col("last_tag"), tag_draft(F.col("last_tag"), F.col("last_sha")))
    return _finding(span, "release", 8 * STEP, text, tag_draft(F.col("first_tag"), F.col("first_sha")), end)


def engineering_findings(*, people, summaries, changes, files, tags, commits, documents, manifests, steps, sections) -> DataFrame:
    practice, inv = commit_practice(people, summaries), inventory(files)
    return reduce(DataFrame.unionByName, [
        testing_findings(inv, test_touching_commits(people, changes), practice), script_findings(manifests),
        ci_findings(CI.ci_configurations(documents, steps), steps), type_findings(documents, manifests), lint_findings(files),
        benchmark_findings(inv), documentation_findings(files, sections), release_findings(release_span(tags, commits)),
        process_findings(practice)])
