"""The derived corpus again, as DuckDB SQL common table expressions for the oracle queries."""

from __future__ import annotations

import re

from repochron import rules
from repochron.plans import corpus as C


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def any_match(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {text(p)})" for p in patterns) + ")"


def base(path: str = "path") -> str:
    return f"regexp_extract({path}, '[^/]*\\z')"


def is_doc(path: str = "path") -> str:
    return (
        f"(CASE WHEN regexp_matches({base(path)}, {text(rules.DOC_NAME)}) THEN true"
        f" WHEN regexp_matches({base(path)}, {text(rules.LICENSE_NAME)}) THEN false"
        f" WHEN regexp_matches({path}, {text(rules.DOC_DIRECTORY)}) THEN regexp_matches({path}, {text(rules.DOC_EXTENSION_IN_DOCS)})"
        f" ELSE regexp_matches({path}, {text(rules.DOC_EXTENSION)}) END)")


def is_test(path: str = "path") -> str:
    return f"(NOT {is_doc(path)} AND {any_match(path, rules.TEST_FILE_PATTERNS)})"


def is_vendored(path: str = "path") -> str:
    return any_match(path, rules.VENDORED_PATTERNS)


def ci_system(path: str = "path") -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({path}, {text(p)}) THEN {text(n)}" for n, p in rules.CI_SYSTEMS) + " END)"


def is_lockfile(path: str = "path") -> str:
    return f"({base(path)} IN {in_list(rules.LOCKFILES)})"


def is_manifest(path: str = "path") -> str:
    return f"({base(path)} IN {in_list(rules.MANIFEST_NAMES)} OR regexp_matches({base(path)}, {text(rules.DOTNET_PROJECT)}))"


def is_sensitive(path: str = "path") -> str:
    return f"({any_match(f'lower({base(path)})', rules.SENSITIVE_NAME_PATTERNS)} OR regexp_matches(lower({path}), {text(rules.SENSITIVE_DIRECTORY)}))"


def extension(path: str = "path") -> str:
    """With its dot; empty for dotfiles and names without one."""
    return f"regexp_extract({base(path)}, '^.+(\\.[^.]*)\\z', 1)"


_LANGUAGE_ROWS = ", ".join(
    f"({text(e)}, {text(name)}, {text(kind)})" for name, kind, extensions in rules.LANGUAGES for e in extensions)


def is_test_source(path: str = "path") -> str:
    programming = in_list(e for _, kind, es in rules.LANGUAGES if kind == "programming" for e in es)
    ext = f"substr({extension(path)}, 2)"
    return (f"({is_test(path)} AND NOT regexp_matches({path}, {text(rules.TEST_SUPPORT)})"
            f" AND {base(path)} NOT IN ('Dockerfile', 'Makefile') AND ({ext} IN {programming} OR lower({ext}) IN {programming}))")


def area(path: str = "path") -> str:
    roots = in_list(rules.SOURCE_ROOTS)
    return (
        f"(CASE WHEN {ci_system(path)} IS NOT NULL OR starts_with({path}, '.github/') THEN 'ci'"
        f" WHEN NOT contains({path}, '/') THEN CASE WHEN {is_doc(path)} THEN 'documentation' ELSE 'project root' END"
        f" WHEN lower(split_part({path}, '/', 1)) IN {roots} AND len(string_split({path}, '/')) >= 3"
        f" THEN split_part({path}, '/', 1) || '/' || split_part({path}, '/', 2)"
        f" ELSE split_part({path}, '/', 1) END)")


def topic_key(label: str) -> str:
    last = f"coalesce(list_last(list_filter(string_split(lower({label}), '/'), lambda s: s <> '')), lower({label}))"
    return (f"(CASE WHEN {last} IN ('tests', 'spec') THEN 'test' WHEN {last} IN ('documentation', 'doc') THEN 'docs' ELSE {last} END)")


def release_weight(name: str = "name") -> str:
    n = f"trim({name})"
    v = text(rules.PROJECT_VERSION)
    suffix = f"regexp_extract({n}, {v}, 4)"
    patch = f"regexp_extract({n}, {v}, 3)"
    return (
        f"CAST(CASE WHEN NOT regexp_matches({n}, {v}) THEN 0.0"
        f" WHEN {suffix} <> '' AND regexp_matches({suffix}, {text(rules.PRERELEASE_SUFFIX)}) THEN 0.3"
        f" WHEN {suffix} <> '' AND NOT regexp_matches({suffix}, '^[0-9]') THEN 0.0"
        f" WHEN {patch} = '' OR CAST({patch} AS BIGINT) = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE)")


def join_words(words: str) -> str:
    """The list joined as "a", "a and b" or "a, b, and c"."""
    return (f"(CASE WHEN coalesce(len({words}), 0) = 0 THEN '' WHEN len({words}) <= 2 THEN array_to_string({words}, ' and ')"
            f" ELSE array_to_string({words}[:-2], ', ') || ', and ' || {words}[-1] END)")


def format_count(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def plural(value: str, singular: str, many: str | None = None) -> str:
    return f"({format_count(value)} || CASE WHEN {value} = 1 THEN {text(' ' + singular)} ELSE {text(' ' + (many or singular + 's'))} END)"


def code_span(value: str) -> str:
    single = f"regexp_replace({value}, '\\s*[\\r\\n]+\\s*', ' ', 'g')"
    return f"(CASE WHEN contains({single}, '`') OR {single} = '' THEN '“' || {single} || '”' ELSE '`' || {single} || '`' END)"


def truncate(value: str, limit: int) -> str:
    single = f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"
    cut = f"left({single}, {limit - 1})"
    space = f"(len({cut}) - strpos(reverse({cut}), ' '))"
    body = f"CASE WHEN strpos({cut}, ' ') > 0 AND {space} > {limit} * 0.6 THEN left({cut}, {space}) ELSE {cut} END"
    return f"(CASE WHEN len({single}) <= {limit} THEN {single} ELSE regexp_replace({body}, '[\\s,;:.–—-]+\\z', '') || '…' END)"


def strip_markdown(value: str) -> str:
    for pattern, replacement in [
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\[[^\]]*\]", r"\1"), (r"<[^>]+>", ""),
        (r"\*\*(.+?)\*\*", r"\1"), (r"__(.+?)__", r"\1"),
    ]:
        value = f"regexp_replace({value}, {text(pattern)}, {text(replacement)}, 'g')"
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


def format_date(raw: str) -> str:
    return f"strftime(CAST(left({raw}, 10) AS DATE), '%b %-d, %Y')"


def subject_text(subject: str = "subject") -> str:
    word = f"lower(regexp_extract({subject}, {text(rules.CONVENTIONAL_PREFIX)}, 1))"
    return f"(CASE WHEN {word} IN {in_list(rules.TYPE_ALIASES)} THEN trim(substr({subject}, strpos({subject}, ':') + 1)) ELSE trim({subject}) END)"


def _by_path(templates) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(path, {text(p)}) THEN {text(t)}" for p, t in templates) + " END"


def _kind_by_keyword(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {text(p)}) THEN {text(k)}" for p, k in rules.KEYWORD_KINDS) + " END"


_ALIAS = "CASE lower(regexp_extract(subject, {p}, 1)) {w} END".format(
    p=text(rules.CONVENTIONAL_PREFIX),
    w=" ".join(f"WHEN {text(a)} THEN {text(k)}" for a, k in rules.TYPE_ALIASES.items()))

CTES: dict[str, str] = {
    "keyed": f"""
        SELECT CAST(c_nationkey AS BIGINT) AS repo_id, o_orderkey AS k,
          o_orderdate + to_hours(CAST(o_orderkey * 7 % 24 AS BIGINT)) AS local_ts,
          CASE o_custkey % 13 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'Renovate Bot' ELSE c_name END AS author_name
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "kcommits": f"""
        SELECT repo_id, k, sha256(CAST(k AS VARCHAR)) AS sha, substr(sha256(CAST(k AS VARCHAR)), 1, 7) AS short_sha, seq,
          CASE WHEN seq = 0 THEN 0 WHEN seq IN (10, 11) THEN 1 WHEN k % 19 = 0 THEN 2 ELSE 1 END AS n_parents, author_name,
          strftime(local_ts, '%Y-%m-%dT%H:%M:%S') || (['Z', '+01:00', '-08:00'])[CAST(k % 3 AS INT) + 1] AS authored_raw,
          epoch_ms(local_ts) - (CASE k % 3 WHEN 1 THEN 1 WHEN 2 THEN -8 ELSE 0 END) * 3600000 AS authored_ms,
          strftime(local_ts, '%Y-%m-%d') AS authored_date,
          ({items(C.SUBJECTS)})[CAST((k // 3) % 20 AS INT) + 1] AS subject,
          ({items(C.BODIES)})[CAST((k // 5) % 6 AS INT) + 1] AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY local_ts, k) - 1 AS seq FROM keyed)""",
    "commits": "SELECT * EXCLUDE (k) FROM kcommits",
    "repos": """
        SELECT repo_id, 'repo-' || repo_id AS name, CASE WHEN repo_id % 7 <> 3 THEN 'main' END AS branch,
          arg_max(sha, seq) AS head_sha, false AS is_shallow FROM kcommits GROUP BY repo_id""",
    "kchanges": """
        SELECT repo_id, k, sha, seq,
          CASE l_partkey % 18
            WHEN 0 THEN 'src/cli/f' || n || '.ts' WHEN 1 THEN 'src/core/f' || n || '.rs' WHEN 2 THEN 'test/f' || n || '.test.ts'
            WHEN 3 THEN 'docs/f' || n || '.md' WHEN 4 THEN 'README.md' WHEN 5 THEN 'package.json' WHEN 6 THEN 'bun.lock'
            WHEN 7 THEN '.github/workflows/ci' || (n % 3) || '.yml' WHEN 8 THEN 'vendor/f' || n || '.js'
            WHEN 9 THEN CASE WHEN l_partkey % 10 = 5 THEN 'crates/globset/benches/f' ELSE 'crates/globset/src/f' END || n || '.rs'
            WHEN 10 THEN CASE l_partkey % 25 WHEN 3 THEN 'CHANGELOG.md' WHEN 7 THEN 'AGENTS.md' ELSE 'styles/f' || n || '.css' END
            WHEN 11 THEN 'test/fixtures/f' || n || '.json' WHEN 12 THEN CASE WHEN repo_id % 3 = 0 THEN 'Cargo.toml' ELSE 'crates/globset/Cargo.toml' END WHEN 13 THEN 'pkg/f' || n || '_test.go'
            WHEN 14 THEN CASE WHEN l_partkey % 4 = 0 THEN '.env' ELSE '.prettierrc' END WHEN 15 THEN 'tsconfig.json' WHEN 16 THEN 'docs/adr/' || n || '-choice.md' ELSE 'package-lock.json' END AS path,
          row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
          CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'N' THEN 'modified'
            WHEN l_linestatus = 'F' THEN 'deleted' ELSE 'renamed' END AS status,
          CASE WHEN l_partkey % 37 <> 0 THEN CAST(round(l_quantity) AS BIGINT) END AS additions,
          CASE WHEN l_partkey % 37 <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS deletions
        FROM (SELECT *, l_partkey % 50 AS n FROM lineitem) JOIN kcommits ON l_orderkey = k WHERE n_parents <= 1""",
    "changes": """
        SELECT repo_id, sha, seq, pos, path, CASE WHEN status = 'renamed' THEN 'old/' || path END AS previous_path,
          status, additions, deletions
        FROM kchanges
        WHERE NOT (repo_id % 5 = 0 AND path IN ('bun.lock', 'package-lock.json'))
        QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY pos) = 1
        UNION ALL
        SELECT repo_id, sha, seq, 1000, CASE WHEN seq = 11 THEN 'bun.lock' ELSE 'package-lock.json' END, NULL,
          CASE WHEN seq = 10 THEN 'deleted' ELSE 'added' END, 30, 0
        FROM kcommits WHERE repo_id % 5 = 0 AND seq IN (0, 10, 11)""",
    "tags": """
        SELECT CAST(c_nationkey AS BIGINT) AS repo_id,
          CASE (o_orderkey // 40) % 5 WHEN 0 THEN 'v1.' || (o_orderkey // 40) || '.0' WHEN 1 THEN '1.' || (o_orderkey // 40) || '.3'
            WHEN 2 THEN '2.0.' || (o_orderkey // 40) || '-rc.1' WHEN 3 THEN 'ignore-0.4.' || (o_orderkey // 40)
            ELSE 'stable-' || (o_orderkey // 40) END AS name,
          sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 40 = 0""",
    "files": """
        SELECT repo_id, path, CASE WHEN path = 'docs/f9.md' THEN 300000 ELSE n * 97 END AS size, sha256(path) AS object_id,
          CASE WHEN path = 'docs/f7.md' THEN 'symlink' ELSE 'file' END AS kind
        FROM (SELECT repo_id, path, count(*) AS n, arg_max(status, seq * 100000 + pos) AS status FROM changes GROUP BY ALL)
        WHERE status <> 'deleted'""",
    "blobs": f"""
        SELECT repo_id, object_id, replace(replace({_by_path(C.DOCUMENT_TEXTS)}, '{{repo}}', CAST(repo_id AS VARCHAR)),
          '{{n}}', regexp_extract(path, '(\\d+)', 1)) AS text
        FROM files WHERE ({_by_path(C.DOCUMENT_TEXTS)}) IS NOT NULL""",
    "bulk_documents": f"""
        SELECT doc_id % 25 AS repo_id, 'docs/d' || doc_id || '.md' AS path,
          replace(({items(C.BULK_PREFIXES)})[CAST(doc_id % 6 AS INT) + 1], '{{n}}', CAST(doc_id AS VARCHAR)) || text AS text
        FROM documents""",
    "turns": "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations",
    "session_events": f"""
        SELECT conv_id % 25 AS repo_id, conv_id AS session_id, 'session-' || conv_id || '.jsonl' AS file, turn * 3 + o AS pos,
          'line ' || (turn * 3 + o + 1) AS id, (['message', 'command', 'result'])[CAST(o AS INT) + 1] AS kind, role,
          strftime(TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INT)) + to_minutes(10 * turn), '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
          CASE o WHEN 0 THEN text || ' ' || ({items(C.SENTENCES)})[CAST((conv_id * 7 + turn) % 9 AS INT) + 1]
            WHEN 1 THEN ({items(C.COMMANDS)})[CAST(turn % 4 AS INT) + 1] ELSE ({items(C.RESULTS)})[CAST(turn % 3 AS INT) + 1] END AS text,
          CASE WHEN o = 1 THEN ({items(C.COMMANDS)})[CAST(turn % 4 AS INT) + 1] END AS command, CAST(NULL AS VARCHAR) AS tool
        FROM turns, (VALUES (0), (1), (2)) v(o) WHERE o = 0 OR (conv_id + turn) % 4 = 0""",
    # ------------------------------------------------------------- derived facts shared by many oracles
    "languages": f"SELECT * FROM (VALUES {_LANGUAGE_ROWS}) v(ext, language, language_type)",
    "file_languages": f"""
        SELECT f.*, {extension('f.path')} AS extension, coalesce(a.language, b.language) AS language,
          coalesce(a.language_type, b.language_type) AS language_type
        FROM files f LEFT JOIN languages a ON a.ext = substr({extension('f.path')}, 2)
          LEFT JOIN languages b ON b.ext = lower(substr({extension('f.path')}, 2))""",
    "change_facts": f"""
        SELECT repo_id, sha, count(*) AS files_changed,
          CAST(coalesce(sum(additions) FILTER (NOT {is_lockfile()}), 0) AS BIGINT) AS additions,
          CAST(coalesce(sum(deletions) FILTER (NOT {is_lockfile()}), 0) AS BIGINT) AS deletions,
          CASE WHEN bool_and({is_doc()}) THEN 'docs' WHEN bool_and({is_test()}) THEN 'test'
            WHEN bool_and({ci_system()} IS NOT NULL) THEN 'ci' WHEN bool_and({is_lockfile()} OR {is_manifest()}) THEN 'build' END AS changes_kind,
          bool_and({is_doc()}) AS only_docs, bool_or({is_test_source()}) AS touches_tests,
          bool_or(NOT {is_test()} AND NOT {is_doc()} AND NOT {is_lockfile()} AND NOT {is_vendored()}) AS touches_source,
          count(*) FILTER ({is_vendored()}) AS vendored,
          bool_or({is_test_source()} OR (previous_path IS NOT NULL AND {is_test_source('previous_path')})) AS test_commit
        FROM changes GROUP BY repo_id, sha""",
    "classified": f"""
        SELECT c.*, f.* EXCLUDE (repo_id, sha, files_changed, additions, deletions), coalesce(f.files_changed, 0) AS files_changed,
          coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions,
          n_parents > 1 AS is_merge, regexp_matches(trim(author_name), {text(rules.AUTOMATED_AUTHOR)}) AS automated,
          {_ALIAS} AS conventional_kind,
          regexp_extract(trim(subject), {text(rules.AREA_PREFIX)}, 1) AS area_scope,
          CASE WHEN regexp_matches(trim(subject), {text(rules.AREA_PREFIX)})
            THEN regexp_extract(trim(subject), {text(rules.AREA_PREFIX)}, 2) ELSE trim(subject) END AS message
        FROM kcommits c LEFT JOIN change_facts f USING (repo_id, sha)""",
    "summaries": f"""
        SELECT repo_id, k, sha, short_sha, seq, n_parents, author_name, authored_raw, authored_ms, authored_date, subject, body,
          is_merge, automated, files_changed, additions, deletions, additions + deletions AS churn, coalesce(only_docs, false) AS only_docs,
          coalesce(touches_tests, false) AS touches_tests, coalesce(touches_source, false) AS touches_source,
          coalesce(vendored, 0) AS vendored, coalesce(test_commit, false) AS test_commit,
          CASE WHEN is_merge THEN 'merge' WHEN conventional_kind IS NOT NULL THEN conventional_kind
            ELSE coalesce({_kind_by_keyword('message')}, changes_kind, 'other') END AS kind,
          CASE WHEN is_merge THEN 'structure' WHEN conventional_kind IS NOT NULL THEN 'conventional'
            WHEN {_kind_by_keyword('message')} IS NOT NULL THEN 'keyword' WHEN changes_kind IS NOT NULL THEN 'structure' ELSE 'none' END AS source,
          CASE WHEN is_merge THEN NULL
            WHEN conventional_kind IS NOT NULL THEN nullif(lower(trim(regexp_extract(subject, {text(rules.CONVENTIONAL_PREFIX)}, 2))), '')
            ELSE nullif(lower(area_scope), '') END AS scope,
          NOT is_merge AND ((conventional_kind IS NOT NULL AND regexp_extract(subject, {text(rules.CONVENTIONAL_PREFIX)}, 3) = '!')
            OR regexp_matches(body, {text(rules.BREAKING_FOOTER)})) AS breaking
        FROM classified""",
    "people": """
        SELECT * FROM (SELECT *, bool_or(NOT automated) OVER (PARTITION BY repo_id) AS has_people FROM summaries)
        WHERE NOT automated OR NOT has_people""",
    "weighted_tags": f"SELECT *, {release_weight()} AS weight FROM tags",
    "tag_by_commit": """
        SELECT repo_id, sha, arg_max(name, pos) AS tag, max(weight) AS weight, bool_or(weight > 0) AS is_release
        FROM weighted_tags GROUP BY repo_id, sha""",
    "riding": f"""
        SELECT p.*, t.tag, coalesce(t.weight, 0) AS weight,
          coalesce(scope = 'release', false)
            OR (kind IN ('chore', 'build', 'other') AND regexp_matches({subject_text()}, {text(rules.RELEASE_SUBJECT)})) AS bookkeeping,
          is_merge OR coalesce(scope = 'release', false)
            OR (kind IN ('chore', 'build', 'other') AND regexp_matches({subject_text()}, {text(rules.RELEASE_SUBJECT)}))
            OR (churn <= 5 AND files_changed <= 2 AND NOT coalesce(t.is_release, false)) AS rides
        FROM people p LEFT JOIN tag_by_commit t USING (repo_id, sha)""",
    "unit_commits": """
        SELECT *, sum(CASE WHEN rides AND seq > first_seq THEN 0 ELSE 1 END)
            OVER (PARTITION BY repo_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS unit
        FROM (SELECT *, min(seq) OVER (PARTITION BY repo_id) AS first_seq FROM riding)""",
    "topics": f"""
        SELECT repo_id, sha, topic, sum(w) AS weight FROM (
          SELECT repo_id, sha, {topic_key('scope')} AS topic, 1.0 AS w FROM summaries WHERE scope IS NOT NULL
          UNION ALL
          SELECT repo_id, sha, {topic_key(area())} AS topic,
            CAST(1 + coalesce(additions, 0) + coalesce(deletions, 0) AS DOUBLE)
              / sum(1 + coalesce(additions, 0) + coalesce(deletions, 0)) OVER (PARTITION BY repo_id, sha) AS w
          FROM changes) GROUP BY ALL""",
    "candidates": f"""
        SELECT *, CASE
          WHEN {is_sensitive()} OR {is_vendored()} THEN NULL
          WHEN {is_manifest()} AND depth <= 2 THEN depth
          WHEN regexp_matches({base()}, {text(rules.ROOT_TS_CONFIG)}) AND depth = 0 THEN 1
          WHEN {ci_system()} IS NOT NULL THEN 2
          WHEN depth = 0 AND regexp_matches(path, {text(rules.ROOT_README)}) THEN 3
          WHEN depth = 0 AND regexp_matches({base()}, {text(rules.ROOT_LICENSE)}) THEN 4
          WHEN regexp_matches({base()}, {text(rules.DESIGN_DOC)}) AND depth <= 2 THEN 5
          WHEN regexp_matches(path, {text(rules.DECISION_RECORD)}) THEN 6
          WHEN regexp_matches(path, {text(rules.DOCS_ROOT)}) AND {is_doc()} AND regexp_matches(path, {text(rules.MARKDOWN_EXTENSION)}) THEN 7
          END AS priority
        FROM (SELECT *, len(string_split(path, '/')) - 1 AS depth FROM files)""",
    "selection": """
        SELECT repo_id, path, object_id, priority, CASE WHEN reason IS NOT NULL THEN reason WHEN rn <= 200 THEN 'read' ELSE 'over-cap' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, reason IS NULL ORDER BY priority, path) AS rn
          FROM (SELECT *, CASE WHEN kind = 'symlink' THEN 'symlink' WHEN size > 262144 THEN 'too-large' END AS reason
            FROM candidates WHERE priority IS NOT NULL))""",
    "docs": """
        SELECT s.repo_id, s.path, s.priority, b.text FROM selection s JOIN blobs b USING (repo_id, object_id) WHERE outcome = 'read'""",
}


def with_corpus(query: str, extra: dict[str, str] | None = None) -> str:
    """The query behind the common table expressions it refers to, directly or not."""
    available = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in available:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+[a-z]+\b", sql) and name not in needed:
                visit(available[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({available[name]})" for name in needed) + "\n" + query
