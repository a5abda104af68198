"""Queries over repository figures, technologies and engineering practice."""

from __future__ import annotations

from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commits as C
from repochron.functions import text as T
from repochron.operators import ci as CI
from repochron.operators import commits as K
from repochron.operators import decisions, documents, metrics, practice, study, technology
from repochron.operators import manifests as M
from repochron.plans import inputs as I
from repochron.plans import oracle_corpus as O
from repochron.plans.registry import query

# ---------------------------------------------------------------------- oracle helpers
_MATCH = {
    "base": lambda v: f"{O.base()} = {O.text(v)}", "path": lambda v: f"path = {O.text(v)}",
    "stem": lambda v: f"({O.base()} = {O.text(v)} OR starts_with({O.base()}, {O.text(v + '.')}))",
    "base_re": lambda v: f"regexp_matches({O.base()}, {O.text(v)})", "path_re": lambda v: f"regexp_matches(path, {O.text(v)})",
    "prefix": lambda v: f"starts_with(path, {O.text(v)})", "suffix": lambda v: f"ends_with(path, {O.text(v)})",
}


def _sql(value) -> str:
    return "NULL" if value is None else O.text(value)


def _hits(source: str) -> str:
    """Every (path, marker) pair of the distinct paths in a source."""
    return " UNION ALL ".join(
        f"SELECT path, {i} AS marker_pos, {_sql(n)} AS tool, {_sql(k)} AS kind, {_sql(g)} AS tool_group FROM {source} WHERE "
        + " OR ".join(_MATCH[match](v) for v in values)
        for i, (n, k, g, match, values) in enumerate(rules.MARKERS))


EXTRA = {
    "file_paths": f"SELECT DISTINCT path FROM files WHERE NOT {O.is_vendored()}",
    "file_hits": _hits("file_paths"),
    "matches": "SELECT f.repo_id, f.path, h.tool, h.kind, h.tool_group, h.marker_pos FROM files f JOIN file_hits h ON h.path = f.path",
    "change_paths": "SELECT DISTINCT path FROM (SELECT path FROM changes UNION ALL SELECT previous_path FROM changes WHERE previous_path IS NOT NULL)",
    "change_hits": _hits("change_paths"),
    "own_changes": f"SELECT * FROM changes WHERE NOT {O.is_vendored()}",
    "marker_events": """
        SELECT c.repo_id, c.sha, c.seq, c.pos, c.status, c.path, c.previous_path, m.marker_pos, m.tool, m.tool_group,
          n.path IS NOT NULL AS now_hit, b.path IS NOT NULL AS before_hit
        FROM own_changes c
          JOIN (SELECT DISTINCT marker_pos, tool, tool_group FROM change_hits) m ON true
          LEFT JOIN change_hits n ON n.path = c.path AND n.marker_pos = m.marker_pos
          LEFT JOIN change_hits b ON b.path = c.previous_path AND b.marker_pos = m.marker_pos
        WHERE n.path IS NOT NULL OR b.path IS NOT NULL""",
    "history": """
        SELECT e.*, EXISTS (SELECT 1 FROM matches m WHERE m.repo_id = e.repo_id AND m.marker_pos = e.marker_pos) AS present FROM (
          SELECT repo_id, marker_pos, tool, tool_group,
            arg_min({'s': seq, 'p': path}, seq * 100000 + pos) FILTER (status IN ('added', 'renamed', 'copied') AND now_hit AND NOT before_hit) AS a,
            arg_max({'s': seq, 'p': CASE WHEN status = 'renamed' THEN previous_path ELSE path END}, seq * 100000 + pos)
              FILTER ((status = 'deleted' AND now_hit) OR (status = 'renamed' AND before_hit AND NOT now_hit)) AS r
          FROM marker_events GROUP BY ALL) e WHERE a IS NOT NULL OR r IS NOT NULL""",
    "migrations": """
        SELECT g.repo_id, g.marker_pos AS from_pos, g.tool AS from_tool, g.r.s AS removed_seq,
          n.marker_pos AS to_pos, n.tool AS to_tool, n.a.s AS added_seq
        FROM history g JOIN history n ON g.repo_id = n.repo_id AND g.tool_group = n.tool_group AND g.marker_pos <> n.marker_pos
        WHERE g.r IS NOT NULL AND NOT g.present AND n.present AND n.a IS NOT NULL AND abs(n.a.s - g.r.s) <= 3
        QUALIFY row_number() OVER (PARTITION BY g.repo_id, g.marker_pos ORDER BY n.marker_pos) = 1""",
    "events_of_tools": """
        SELECT h.repo_id, tool, 'stopped' AS event, h.r.s AS idx, 0 AS phase, h.marker_pos FROM history h
        WHERE r IS NOT NULL AND NOT present AND NOT EXISTS (SELECT 1 FROM migrations m WHERE m.repo_id = h.repo_id AND m.from_pos = h.marker_pos)
        UNION ALL
        SELECT h.repo_id, tool, 'adopted', h.a.s, 1, h.marker_pos FROM history h
        WHERE a IS NOT NULL AND present AND h.a.s > 0 AND NOT EXISTS (SELECT 1 FROM migrations m WHERE m.repo_id = h.repo_id AND m.to_pos = h.marker_pos)""",
    "shares": f"""
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, language) AS rank, bytes / sum(bytes) OVER (PARTITION BY repo_id) AS share
        FROM (SELECT repo_id, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM file_languages
          WHERE kind <> 'symlink' AND NOT {O.is_vendored()} AND language_type IN ('programming', 'markup') GROUP BY ALL)""",
    "own": f"SELECT * FROM files WHERE NOT {O.is_vendored()}",
    "work": "SELECT * FROM people WHERE NOT is_merge",
    "doc_roles": f"""
        SELECT repo_id, path, CASE
            WHEN len(string_split(path, '/')) <= 2 AND {O.any_match(O.base(), [p for p, _ in rules.NOTABLE_GUIDES])} THEN 'guide'
            WHEN NOT contains(path, '/') AND regexp_matches({O.base()}, {O.text(rules.ASSISTANT_GUIDE)}) THEN 'assistant'
            WHEN regexp_matches(path, {O.text(rules.DECISION_RECORD)}) THEN 'record'
            WHEN path = min(path) FILTER (regexp_matches(path, {O.text(rules.ROOT_README)})) OVER (PARTITION BY repo_id) THEN 'readme'
            WHEN {O.is_doc()} THEN 'other' END AS role FROM own""",
    "manifest_deps": """
        SELECT repo_id, path, section, dependency FROM (
          SELECT repo_id, path, unnest(CASE WHEN ends_with(path, 'package.json') THEN
              list_transform(json_keys(text, '$.dependencies'), lambda k: {'section': 'dependencies', 'dependency': k})
                || list_transform(json_keys(text, '$.devDependencies'), lambda k: {'section': 'development dependencies', 'dependency': k})
            ELSE [{'section': 'dependencies', 'dependency': 'serde'}, {'section': 'dependencies', 'dependency': 'clap'},
                  {'section': 'development dependencies', 'dependency': 'criterion'}] END, recursive := true)
          FROM docs WHERE ends_with(path, 'package.json') OR ends_with(path, 'Cargo.toml'))""",
}

# ---------------------------------------------------------------------- metrics


@query("repo_metrics", f"""
    SELECT e.repo_id, commits, merge_commits, automated_commits, automated_authors, contributors, first_commit_at, latest_commit_at,
      abs(date_diff('day', CAST(left(first_commit_at, 10) AS DATE), CAST(left(latest_commit_at, 10) AS DATE))) + 1 AS timespan_days, active_days,
      tracked_files, files_touched, additions, deletions, test_files, ci_configurations, documentation_files
    FROM (SELECT repo_id, count(*) AS commits, count(*) FILTER (is_merge) AS merge_commits, count(*) FILTER (automated) AS automated_commits,
        coalesce(string_agg(DISTINCT CASE WHEN automated THEN author_name END, ', ' ORDER BY CASE WHEN automated THEN author_name END), '') AS automated_authors
      FROM summaries GROUP BY repo_id) e
    JOIN (SELECT repo_id, count(DISTINCT author_name) AS contributors, count(DISTINCT authored_date) AS active_days,
        arg_min(authored_raw, CAST(authored_ms AS HUGEINT) * 10000000 + seq) AS first_commit_at, arg_max(authored_raw, CAST(authored_ms AS HUGEINT) * 10000000 + seq) AS latest_commit_at,
        CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM people GROUP BY repo_id) p USING (repo_id)
    JOIN (SELECT repo_id, count(DISTINCT path) AS files_touched FROM changes JOIN people USING (repo_id, sha) GROUP BY repo_id) t USING (repo_id)
    JOIN (SELECT repo_id, count(*) AS tracked_files, count(*) FILTER (NOT {O.is_vendored()} AND {O.is_test_source()}) AS test_files,
        count(*) FILTER (NOT {O.is_vendored()} AND {O.ci_system()} IS NOT NULL) AS ci_configurations,
        count(*) FILTER (NOT {O.is_vendored()} AND {O.is_doc()}) AS documentation_files FROM files GROUP BY repo_id) f USING (repo_id)""")
def repo_metrics(c):
    s = I.summaries(c)
    return metrics.repo_metrics(s, K.people(s), c.changes(), c.files()).withColumn("automated_authors", I.joined("automated_authors", ", "))


@query("language_shares", "SELECT repo_id, language, files, bytes, round(share, 9) AS share, rank FROM shares", EXTRA)
def language_shares(c):
    return metrics.language_shares(c.files()).withColumn("share", F.round("share", 9))


@query("language_signals", """
    SELECT s.repo_id, s.language, s.files, s.bytes, round(s.share, 9) AS share,
      (SELECT string_agg(DISTINCT extension, '/' ORDER BY extension) FROM file_languages f WHERE f.repo_id = s.repo_id AND f.language = s.language) AS extensions,
      (SELECT array_to_string(list_sort(list(path))[1:5], ';') FROM file_languages f WHERE f.repo_id = s.repo_id AND f.language = s.language) AS samples
    FROM shares s WHERE rank <= 6 AND (share >= 0.02 OR rank = 1)""", EXTRA)
def language_signals(c):
    return metrics.language_signals(c.files()).select(
        "repo_id", "language", "files", "bytes", F.round("share", 9).alias("share"), I.joined("extensions", "/").alias("extensions"), I.joined("samples", ";").alias("samples"))


_NOUN_ROWS = ", ".join(f"({O.text(k)}, {O.text(a)}, {O.text(b)})" for k, (a, b) in rules.KIND_NOUNS.items())


@query("commit_kind_mix", f"""
    SELECT repo_id, commits, round(share, 9) AS conventional_share, level,
      'By type, the commits comprise ' || {O.join_words('words')} || ', ' || CASE level WHEN 'observed' THEN 'as labeled by their Conventional Commits prefixes'
        ELSE 'classified from commit wording and changed files' END || '.' AS text
    FROM (SELECT repo_id, count(*) AS commits, avg(CASE WHEN source = 'conventional' THEN 1.0 ELSE 0.0 END) AS share,
        CASE WHEN share >= 0.8 THEN 'observed' ELSE 'inferred' END AS level FROM work GROUP BY repo_id HAVING count(*) >= 2)
    JOIN (SELECT repo_id, list({O.format_count('n')} || ' ' || CASE WHEN n = 1 THEN one ELSE many END ORDER BY n DESC, kind) AS words
      FROM (SELECT repo_id, kind, count(*) AS n FROM work GROUP BY ALL) JOIN (SELECT * FROM (VALUES {_NOUN_ROWS}) v(kind, one, many)) USING (kind) GROUP BY repo_id) USING (repo_id)""", EXTRA)
def commit_kind_mix(c):
    return metrics.commit_kind_mix(I.people(c)).withColumn("conventional_share", F.round("conventional_share", 9))


@query("conventional_share", """
    SELECT repo_id, count(*) AS commits, count(*) FILTER (source = 'conventional') AS conventional,
      round(count(*) FILTER (source = 'conventional') / count(*), 9) AS share, count(*) >= 3 AND count(*) FILTER (source = 'conventional') / count(*) >= 0.5 AS is_finding
    FROM work GROUP BY repo_id""", EXTRA)
def conventional_share(c):
    s = I.summaries(c)
    return practice.conventional_share(practice.commit_practice(K.people(s), s)).select(
        "repo_id", "commits", "conventional", F.round("share", 9).alias("share"), "is_finding")


@query("message_body_share", """
    SELECT repo_id, count(*) AS commits, count(*) FILTER (len(trim(body)) >= 20) AS with_body,
      round(count(*) FILTER (len(trim(body)) >= 20) / count(*), 9) AS share,
      count(*) >= 3 AND count(*) FILTER (len(trim(body)) >= 20) / count(*) >= 0.25 AS is_finding,
      array_to_string((list(short_sha ORDER BY seq) FILTER (len(trim(body)) >= 20))[1:20], ' ') AS sample
    FROM work GROUP BY repo_id""", EXTRA)
def message_body_share(c):
    s = I.summaries(c)
    return practice.message_body_share(practice.commit_practice(K.people(s), s)).select(
        "repo_id", "commits", "with_body", F.round("share", 9).alias("share"), "is_finding", I.joined("body_sample", " ").alias("sample"))


_TOUCH = {**EXTRA, "touch": "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS ordinal FROM work"}


@query("test_touching_commits", f"""
    SELECT w.repo_id, count(*) AS commits, count(*) FILTER (test_commit) AS touching, arg_min(sha, seq) FILTER (test_commit) AS first_sha,
      arg_max(sha, seq) FILTER (test_commit) AS last_sha, min(ordinal) FILTER (test_commit) AS ordinal,
      (SELECT arg_min(path, pos) FROM changes c WHERE c.repo_id = w.repo_id AND {O.is_test_source()}
        AND c.seq = (SELECT min(seq) FROM touch t WHERE t.repo_id = w.repo_id AND t.test_commit)) AS first_path
    FROM touch w GROUP BY w.repo_id HAVING count(*) FILTER (test_commit) > 0""", _TOUCH)
def test_touching_commits(c):
    return practice.test_touching_commits(I.people(c), c.changes()).select("repo_id", "commits", "touching", "first_sha", "last_sha", "ordinal", "first_path")


@query("first_test_ordinal", "SELECT repo_id, min(ordinal) AS ordinal FROM touch WHERE test_commit GROUP BY repo_id", _TOUCH)
def first_test_ordinal(c):
    return practice.test_touching_commits(I.people(c), c.changes()).select("repo_id", "ordinal")


# ---------------------------------------------------------------------- markers and technologies
@query("marker_matches", "SELECT * FROM matches", EXTRA)
def marker_matches(c):
    return technology.marker_matches(c.files())


@query("marker_files", """
    SELECT repo_id, tool, count(*) AS n, array_to_string(list_sort(list(path))[1:3], ', ') AS first_three, array_to_string(list_sort(list(path))[1:10], ', ') AS first_ten
    FROM matches GROUP BY repo_id, tool""", EXTRA)
def marker_files(c):
    return technology.marker_files(technology.marker_matches(c.files())).select(
        "repo_id", "tool", "n", F.array_join(F.slice("paths", 1, 3), ", ").alias("first_three"), I.joined("paths", ", ").alias("first_ten"))


_RULES = ", ".join(f"({O.text(e)}, {i}, {O.text(m.rstrip('*'))}, {str(m.endswith('*')).lower()}, {O.text(n)}, {O.text(k)})"
                   for e, rows in rules.DEPENDENCY_RULES.items() for i, (m, n, k) in enumerate(rows))


@query("dependency_technologies", f"""
    SELECT d.repo_id, d.path, d.section, d.dependency, r.name, r.kind
    FROM manifest_deps d JOIN (SELECT * FROM (VALUES {_RULES}) v(ecosystem, rule_pos, match, is_prefix, name, kind)) r
      ON r.ecosystem = CASE WHEN ends_with(d.path, '.toml') THEN 'cargo' ELSE 'npm' END
        AND (r.match = d.dependency OR (r.is_prefix AND starts_with(d.dependency, r.match)))
    QUALIFY row_number() OVER (PARTITION BY d.repo_id, d.path, d.section, d.dependency ORDER BY rule_pos) = 1""", EXTRA)
def dependency_technologies(c):
    return technology.dependency_technologies(I.ordered_manifests(c)).select("repo_id", "path", "section", "dependency", "name", "kind")


@query("signal_union", f"""
    SELECT repo_id, name, kind, level, count(*) AS signals FROM (
      SELECT repo_id, language AS name, 'language' AS kind, 'inferred' AS level FROM shares WHERE rank <= 6 AND (share >= 0.02 OR rank = 1)
      UNION ALL SELECT DISTINCT repo_id, tool, kind, 'observed' FROM matches
      UNION ALL SELECT repo_id, r.name, r.kind, 'observed' FROM manifest_deps d JOIN (SELECT * FROM (VALUES {_RULES}) v(ecosystem, rule_pos, match, is_prefix, name, kind)) r
        ON r.match = d.dependency AND r.ecosystem = CASE WHEN ends_with(d.path, '.toml') THEN 'cargo' ELSE 'npm' END)
    GROUP BY ALL""", EXTRA)
def signal_union(c):
    return technology.signals(c.files(), I.ordered_manifests(c)).groupBy("repo_id", "name", "kind", "level").agg(F.count(F.lit(1)).alias("signals"))


_KIND_RANK = "list_position(" + O.items(rules.TECHNOLOGY_KIND_ORDER) + ", kind)"


@query("technologies", f"""
    SELECT repo_id, name, (({O.items(rules.TECHNOLOGY_KIND_ORDER)})[min({_KIND_RANK})]) AS kind,
      CASE WHEN bool_or(level = 'observed') THEN 'observed' ELSE 'inferred' END AS level, string_agg(basis, '; ' ORDER BY ord, basis) AS basis
    FROM (
      SELECT s.repo_id, s.language AS name, 'language' AS kind, 'inferred' AS level, 0 AS ord, s.files || ' ' ||
        (SELECT string_agg(DISTINCT '`' || extension || '`', '/' ORDER BY '`' || extension || '`') FROM file_languages f WHERE f.repo_id = s.repo_id AND f.language = s.language)
        || ' file' || CASE WHEN s.files = 1 THEN '' ELSE 's' END || ' (' || CASE WHEN s.share < 0.005 THEN '<1' ELSE CAST(CAST(floor(s.share * 100 + 0.5) AS BIGINT) AS VARCHAR) END
        || '% of source bytes), classified by file extension' AS basis
      FROM shares s WHERE rank <= 6 AND (share >= 0.02 OR rank = 1)
      UNION ALL
      SELECT repo_id, tool, kind, 'observed', 1, array_to_string(list_transform(list_sort(list(path))[1:3], lambda p: '`' || p || '`'), ', ')
        || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END || ' tracked' FROM matches GROUP BY repo_id, tool, kind
      UNION ALL
      SELECT d.repo_id, r.name, r.kind, 'observed', 2, '`' || d.dependency || '` in `' || d.path || '` ' || d.section
      FROM manifest_deps d JOIN (SELECT * FROM (VALUES {_RULES}) v(ecosystem, rule_pos, match, is_prefix, name, kind)) r
        ON r.match = d.dependency AND r.ecosystem = CASE WHEN ends_with(d.path, '.toml') THEN 'cargo' ELSE 'npm' END)
    GROUP BY repo_id, name""", EXTRA)
def technologies(c):
    return technology.technologies(technology.signals(c.files(), I.ordered_manifests(c))).select("repo_id", "name", "kind", "level", "basis")


@query("marker_history", """
    SELECT repo_id, tool, present, a.s AS added_idx, a.p AS added_path, r.s AS removed_idx, r.p AS removed_path FROM history""", EXTRA)
def marker_history(c):
    return technology.marker_history(c.commits(), c.changes(), c.files()).select(
        "repo_id", "tool", "present", F.col("added_seq").alias("added_idx"), "added_path", F.col("removed_seq").alias("removed_idx"), "removed_path")


@query("tool_migrations", "SELECT repo_id, from_tool, to_tool, removed_seq AS removed_idx, added_seq AS added_idx FROM migrations", EXTRA)
def tool_migrations(c):
    return technology.tool_migrations(I.marker_history(c)).select(
        "repo_id", "from_tool", "to_tool", F.col("removed_seq").alias("removed_idx"), F.col("added_seq").alias("added_idx"))


@query("tool_adopted_or_stopped", "SELECT repo_id, tool, event, idx FROM events_of_tools", EXTRA)
def tool_adopted_or_stopped(c):
    history = I.marker_history(c)
    return technology.tool_events(history, technology.tool_migrations(history)).select("repo_id", "tool", "event", "idx")


@query("top_tooling_decisions", """
    SELECT repo_id, title, idx, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY idx, phase, marker_pos) AS rank FROM (
        SELECT repo_id, 'Moved from ' || from_tool || ' to ' || to_tool AS title, least(removed_seq, added_seq) AS idx, 0 AS phase, from_pos AS marker_pos FROM migrations
        UNION ALL SELECT repo_id, CASE event WHEN 'stopped' THEN 'Stopped using ' ELSE 'Adopted ' END || tool, idx, phase, marker_pos FROM events_of_tools))
    WHERE rank <= 10""", EXTRA)
def top_tooling_decisions(c):
    return technology.tooling_decisions(I.marker_history(c)).select("repo_id", "title", "idx", "rank")


# ---------------------------------------------------------------------- files, documents, releases
@query("top_level_directories", f"""
    SELECT repo_id, len(d) AS total, array_to_string(d[1:12], ' ') AS directories,
      {O.join_words("CASE WHEN len(d) > 6 THEN list_append(list_transform(d[1:6], lambda x: '`' || x || '/`'), (len(d) - 6) || CASE WHEN len(d) = 7 THEN ' other directory' ELSE ' other directories' END) ELSE list_transform(d, lambda x: '`' || x || '/`') END")} AS text
    FROM (SELECT repo_id, list_sort(list(DISTINCT split_part(path, '/', 1))) AS d FROM own
      WHERE contains(path, '/') AND split_part(path, '/', 1) <> '' AND NOT starts_with(path, '.') GROUP BY repo_id)""", EXTRA)
def top_level_directories(c):
    return metrics.top_level_directories(c.files()).select("repo_id", "total", I.joined("directories", " ").alias("directories"), "text")


@query("skipped_documents", """
    SELECT repo_id, count(*) AS skipped, string_agg(DISTINCT outcome, ', ' ORDER BY outcome) AS reasons
    FROM selection WHERE outcome IN ('symlink', 'too-large') GROUP BY repo_id""")
def skipped_documents(c):
    rows = documents.select_documents(c.files()).filter("outcome in ('symlink', 'too-large')").withColumnRenamed("outcome", "reason")
    return study.skipped_documents(rows).withColumn("reasons", I.joined("reasons", ", "))


@query("release_span", """
    SELECT repo_id, count(*) AS tags, count(*) FILTER (weight > 0) AS releases,
      coalesce(arg_min(name, seq) FILTER (weight > 0), arg_min(name, seq)) AS first_tag, coalesce(arg_max(name, seq) FILTER (weight > 0), arg_max(name, seq)) AS last_tag
    FROM weighted_tags JOIN commits USING (repo_id, sha) GROUP BY repo_id""")
def release_span(c):
    return practice.release_span(c.tags(), c.commits()).select("repo_id", "tags", "releases", "first_tag", "last_tag")


@query("test_ci_doc_inventory", f"""
    SELECT repo_id, count(*) FILTER ({O.is_test_source()}) AS test_files, count(*) FILTER ({O.ci_system()} IS NOT NULL) AS ci_files,
      count(*) FILTER ({O.is_doc()}) AS documentation_files,
      count(*) FILTER (regexp_matches(path, {O.text(rules.BENCH_DIRECTORY)}) OR regexp_matches(path, {O.text(rules.BENCH_NAME)})) AS benchmark_files,
      bool_or(ends_with(path, '.rs')) AS rust_caveat, array_to_string(list_sort(list(path) FILTER ({O.is_test_source()}))[1:12], ' ') AS test_sample
    FROM own GROUP BY repo_id""", EXTRA)
def test_ci_doc_inventory(c):
    return practice.inventory(c.files()).select(
        "repo_id", "test_files", "ci_files", "documentation_files", "benchmark_files", "rust_caveat", I.joined("test_sample", " ").alias("test_sample"))


@query("other_documentation", "SELECT repo_id, path FROM doc_roles WHERE role = 'other'", EXTRA)
def other_documentation(c):
    return practice.other_documentation(c.files())


@query("documentation_inventory", """
    SELECT repo_id, role, count(*) AS files, min(path) AS first_path FROM doc_roles WHERE role IS NOT NULL GROUP BY repo_id, role""", EXTRA)
def documentation_inventory(c):
    return practice.documentation_roles(c.files()).groupBy("repo_id", "role").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@query("lint_configuration", f"""
    SELECT repo_id, string_agg(tool || '=' || path, ' ' ORDER BY marker_pos) AS tools
    FROM (SELECT repo_id, tool, marker_pos, min(path) AS path FROM matches WHERE tool IN {O.in_list(rules.LINT_TOOLS)} GROUP BY ALL) GROUP BY repo_id""",
       EXTRA)
def lint_configuration(c):
    return practice.lint_configuration(c.files()).select("repo_id", F.array_join(F.transform("tools", lambda t: F.concat(t["tool"], F.lit("="), t["path"])), " ").alias("tools"))


@query("type_check_configuration", """
    SELECT repo_id, 'strict noUnusedLocals' AS flags, 4 AS line FROM docs WHERE path = 'tsconfig.json'""")
def type_check_configuration(c):
    return practice.type_check_configuration(I.read_documents(c)).select("repo_id", I.joined("flags", " ").alias("flags"), "line")


# ---------------------------------------------------------------------- manifests and CI
@query("manifest_facts")
def manifest_facts(c):
    return M.manifest_facts(I.read_documents(c)).select(
        "repo_id", "path", "ecosystem", "name", "description", "version", "license", "homepage", F.to_json("scripts").alias("scripts"), I.joined("dependencies", " ").alias("dependencies"),
        I.joined("dev_dependencies", " ").alias("dev_dependencies"), I.joined("binaries", " ").alias("binaries"), F.to_json("details").alias("details"))


@query("manifest_facts_npm", """
    SELECT repo_id, path, json_extract_string(text, '$.name') AS name, json_extract_string(text, '$.version') AS version,
      json_extract_string(text, '$.description') AS description, json_extract_string(text, '$.license') AS license,
      json_extract_string(text, '$.repository.url') AS homepage, array_to_string(json_keys(text, '$.scripts'), ' ') AS scripts,
      array_to_string(json_keys(text, '$.dependencies'), ' ') AS dependencies, array_to_string(json_keys(text, '$.devDependencies'), ' ') AS dev_dependencies,
      replace(json_extract_string(text, '$.name'), '@scope/', '') AS binaries
    FROM docs WHERE regexp_matches(path, '(^|/)package.json\\z')""")
def manifest_facts_npm(c):
    return M.manifest_facts(I.read_documents(c)).filter("ecosystem = 'npm'").select(
        "repo_id", "path", "name", "version", "description", "license", "homepage", I.joined("script_order", " ").alias("scripts"),
        I.joined("dependencies", " ").alias("dependencies"), I.joined("dev_dependencies", " ").alias("dev_dependencies"), I.joined("binaries", " ").alias("binaries"))


@query("manifest_order", f"""
    SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY len(string_split(path, '/')), lower(path)) AS manifest_pos FROM docs WHERE {O.is_manifest()}""")
def manifest_order(c):
    return I.ordered_manifests(c).select("repo_id", "path", "manifest_pos")


@query("document_order", f"""
    SELECT repo_id, path, CASE WHEN regexp_matches(path, {O.text(rules.DECISION_RECORD)}) THEN 0 WHEN regexp_matches(path, {O.text(rules.RANKED_DESIGN_DOC)}) THEN 1
      WHEN contains(path, '/') THEN 3 ELSE 2 END AS doc_rank
    FROM docs WHERE {O.is_doc()} AND NOT regexp_matches({O.base()}, {O.text(rules.ASSISTANT_GUIDE)}) AND NOT regexp_matches(path, {O.text(rules.HISTORY_FILE)})""")
def document_order(c):
    return decisions.document_order(I.read_documents(c)).select("repo_id", "path", F.col("doc_rank").cast("long").alias("doc_rank"))


_CI = {
    "root": f"SELECT repo_id, arg_min(path, lower(path)) AS root FROM docs WHERE {O.is_manifest()} AND NOT contains(path, '/') GROUP BY repo_id",
    "workflow_steps": """
        SELECT d.repo_id, d.path, s.line, s.command, coalesce(root = 'package.json', false) AS has_scripts FROM docs d
        JOIN (VALUES ('.github/workflows/ci0.yml', 7, 'bun run lint'), ('.github/workflows/ci0.yml', 10, 'bun test'), ('.github/workflows/ci0.yml', 11, 'bun run check'),
          ('.github/workflows/ci1.yml', 6, 'echo repo {repo}'), ('.github/workflows/ci2.yml', 7, 'cat <<EOF > notes.txt'), ('.github/workflows/ci2.yml', 10, 'npm publish')
        ) s(path, line, template) ON d.path = s.path CROSS JOIN LATERAL (SELECT replace(s.template, '{repo}', CAST(d.repo_id AS VARCHAR)) AS command) LEFT JOIN root r ON r.repo_id = d.repo_id""".replace(
        "s.command", "command"),
    "purposed": """
        SELECT repo_id, path, line, command, CASE command WHEN 'bun run lint' THEN 'lint' WHEN 'bun test' THEN 'test'
          WHEN 'bun run check' THEN CASE WHEN has_scripts THEN 'test lint' ELSE '' END ELSE '' END AS purposes,
          CASE WHEN has_scripts AND command LIKE 'bun%' THEN regexp_extract(command, '(\\w+)\\z', 1) END AS script_name FROM workflow_steps""",
}


@query("ci_steps", "SELECT repo_id, path, 'GitHub Actions' AS system, line, command, purposes, script_name FROM purposed", _CI)
def ci_steps(c):
    return I.ci_steps(c).select("repo_id", "path", "system", "line", "command", I.joined("purposes", " ").alias("purposes"), "script_name")


@query("ci_unrecognized", """
    SELECT repo_id, count(*) AS configurations, count(*) FILTER (n = 0) AS unrecognized, coalesce(string_agg(CASE WHEN n = 0 THEN path END, ' ' ORDER BY path), '') AS paths
    FROM (SELECT repo_id, path, count(*) FILTER (purposes <> '') AS n FROM purposed GROUP BY ALL) GROUP BY repo_id""", _CI)
def ci_unrecognized(c):
    docs = I.read_documents(c)
    return practice.ci_unrecognized(CI.ci_configurations(docs, I.ci_steps(c))).withColumn("paths", I.joined("paths", " "))


@query("ci_purposeful_steps", f"""
    SELECT repo_id, path, {O.join_words('list(w ORDER BY line)')} AS described FROM (
      SELECT *, '`' || command || '`' || CASE script_name WHEN 'lint' THEN ' (script: `eslint .`)' WHEN 'test' THEN ' (script: `bun test`)'
          WHEN 'check' THEN ' (script: `bun run lint && bun run test`)' ELSE '' END
        || ' for ' || CASE purposes WHEN 'lint' THEN 'linting' WHEN 'test' THEN 'tests' ELSE 'tests and linting' END AS w FROM purposed WHERE purposes <> '')
    GROUP BY repo_id, path""", _CI)
def ci_purposeful_steps(c):
    return practice.ci_purposeful_steps(I.ci_steps(c)).select("repo_id", "path", T.join_words("described").alias("described"))


@query("resolve_scripts", """
    SELECT DISTINCT p.repo_id, p.command, s.script_name, s.step FROM purposed p JOIN (VALUES
      ('bun run lint', 'lint', 1), ('bun test', 'test', 1), ('bun run check', 'check', 1), ('bun run check', 'lint', 2), ('bun run check', 'test', 3)) s(command, script_name, step)
    USING (command) WHERE p.script_name IS NOT NULL""".replace("SELECT DISTINCT p.repo_id, p.command,", "SELECT DISTINCT p.repo_id, command,"), _CI)
def resolve_scripts(c):
    docs = I.read_documents(c)
    commands = CI.ci_entries(docs).filter("entry = 'command'").select("repo_id", F.col("value").alias("command")).distinct()
    scripts = CI.root_scripts(I.ordered_manifests(c))
    return CI.resolve_scripts(commands.join(scripts, "repo_id", "left")).select("repo_id", "command", "script_name", "step")


@query("package_scripts", """
    SELECT d.repo_id, d.path, s.name, s.command, s.purposes, s.area FROM docs d JOIN root r ON r.repo_id = d.repo_id AND r.root = d.path
    JOIN (VALUES ('test', 'bun test', 'test', 'testing'), ('lint', 'eslint .', 'lint', 'linting'), ('check', 'bun run lint && bun run test', 'test lint', 'testing'))
      s(name, command, purposes, area) ON d.path = 'package.json'""", _CI)
def package_scripts(c):
    return practice.package_scripts(I.ordered_manifests(c)).select("repo_id", "path", "name", "command", I.joined("purposes", " ").alias("purposes"), "area")


@query("project_identity", f"""
    SELECT r.repo_id, CASE WHEN root = 'package.json' THEN '@scope/pkg-' || r.repo_id WHEN root = 'Cargo.toml' THEN 'crate-' || r.repo_id ELSE r.name END AS name,
      CASE WHEN root = 'package.json' THEN 'Package ' || r.repo_id || ' of the derived corpus'
        WHEN d.path IS NOT NULL THEN 'Repo ' || r.repo_id || ' keeps plain records of work and explains how they came about.' END AS description,
      r.branch, r.head_sha, CASE WHEN root = 'package.json' THEN 'https://example.com/pkg-' || r.repo_id END AS homepage,
      CASE WHEN root = 'package.json' THEN 'MIT' END AS license,
      CASE WHEN root = 'package.json' THEN '1.' || r.repo_id || '.0' WHEN root = 'Cargo.toml' THEN '0.' || r.repo_id || '.1' END AS version
    FROM repos r LEFT JOIN root USING (repo_id) LEFT JOIN docs d ON d.repo_id = r.repo_id AND d.path = 'README.md'""", _CI)
def project_identity(c):
    return I.study(c).identity.select("repo_id", "name", "description", "branch", "head_sha", "homepage", "license", "version")


@query("safe_homepage", """
    SELECT page_id, url, CASE WHEN regexp_matches(url, '^https?://[^/@]+(/|\\z)') THEN
      CASE WHEN regexp_matches(url, '^https?://[^/]+\\z') THEN lower(url) || '/' ELSE lower(regexp_extract(url, '^https?://[^/]+')) || regexp_replace(url, '^https?://[^/]+', '') END END AS homepage
    FROM (SELECT page_id, regexp_replace(url, '\\.git\\z', '') AS url FROM pages)""".replace("SELECT page_id, url, CASE", "SELECT page_id, CASE"))
def safe_homepage(c):
    return c.raw("pages").select("page_id", study.safe_homepage("url").alias("homepage"))
