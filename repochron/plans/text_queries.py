"""Queries over texts: Markdown, sentences, decisions, commands and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commands as S
from repochron.functions import text as T
from repochron.operators import decisions, markdown, sessions
from repochron.plans import corpus as CORPUS
from repochron.plans import inputs as I
from repochron.plans import oracle_corpus as O
from repochron.plans.registry import query

# ---------------------------------------------------------------------- strings, dates, numbers


@query("truncate_text", f"SELECT doc_id, {O.truncate('text', 80)} AS short, {O.truncate('text', 280)} AS longer FROM documents")
def truncate_text(c):
    return c.raw("documents").select("doc_id", T.truncate("text", 80).alias("short"), T.truncate("text", 280).alias("longer"))


@query("strip_inline_markdown", f"SELECT repo_id, path, {O.strip_markdown('text')} AS plain FROM bulk_documents")
def strip_inline_markdown(c):
    return c.bulk_documents().select("repo_id", "path", T.strip_markdown("text").alias("plain"))


_BLOCK = r"^\s*([-*+>]|[0-9]+[.)]|#{1,6}\s|```|~~~)"
_LINES = {
    "doc_lines": "SELECT repo_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT repo_id, path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM bulk_documents)",
    "logical": f"""
        SELECT repo_id, path, g, string_agg(trim(line, ' ' || chr(9) || chr(13)), ' ' ORDER BY n) AS line FROM (
          SELECT *, sum(CASE WHEN blank OR starts OR prev_blank THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path ORDER BY n) AS g FROM (
            SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, regexp_matches(line, {O.text(_BLOCK)}) AS starts,
              coalesce(lag(trim(line, ' ' || chr(9) || chr(13)) = '') OVER (PARTITION BY repo_id, path ORDER BY n), true) AS prev_blank FROM doc_lines))
        WHERE NOT blank GROUP BY ALL""",
}


@query("unwrap_lines", """
    SELECT repo_id, path, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY g)) AS digest FROM logical GROUP BY ALL""", _LINES)
def unwrap_lines(c):
    lines = T.unwrap_lines("text")
    return c.bulk_documents().select("repo_id", "path", lines.alias("l")).filter(F.size("l") > 0).select(
        "repo_id", "path", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("sentences", """
    SELECT repo_id, path, n AS pos, sentence FROM (
      SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, path ORDER BY g, i) - 1 AS n, sentence FROM (
        SELECT repo_id, path, g, generate_subscripts(p, 1) AS i, trim(unnest(p)) AS sentence FROM (
          SELECT repo_id, path, g, CASE WHEN len(m) = 0 THEN [clean] ELSE m END AS p FROM (
            SELECT *, regexp_extract_all(regexp_replace(clean, '([.!?])(\\S)', '\\1' || chr(2) || '\\2', 'g'), '(?:`[^`]*`|[^.!?`]|[.!?]' || chr(2) || ')+[.!?]*') AS m FROM (
              SELECT *, trim(regexp_replace(line, '^\\s*([-*+>]|[0-9]+[.)])\\s+', '')) AS clean FROM logical) WHERE clean <> ''))) WHERE sentence <> '')""".replace(
    "trim(unnest(p)) AS sentence", "trim(replace(unnest(p), chr(2), '')) AS sentence"), _LINES)
def sentences(c):
    return c.bulk_documents().select("repo_id", "path", F.posexplode(T.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("join_words", f"""
    SELECT repo_id, {O.join_words('names')} AS words FROM (SELECT repo_id, list(DISTINCT name ORDER BY name)[1:CAST(repo_id % 4 AS INT)] AS names FROM tags GROUP BY repo_id)""")
def join_words(c):
    names = c.tags().groupBy("repo_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("repo_id", T.join_words(F.slice("names", F.lit(1), (F.col("repo_id") % 4).cast("int"))).alias("words"))


@query("format_count", f"SELECT o_orderkey, {O.format_count('o_totalprice')} AS price, {O.plural('o_orderkey % 3', 'file')} AS files FROM orders".replace(
    "CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)"))
def format_count(c):
    return c.raw("orders").select("o_orderkey", T.format_count("o_totalprice").alias("price"), T.plural(F.col("o_orderkey") % 3, "file").alias("files"))


@query("code_span", f"SELECT doc_id, {O.code_span('text')} AS span FROM documents")
def code_span(c):
    return c.raw("documents").select("doc_id", T.code_span("text").alias("span"))


@query("sanitize_text", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F‪-‮⁦-⁩]', '�', 'g') AS clean FROM documents".replace(
    "‪-‮⁦-⁩", "\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}"))
def sanitize_text(c):
    return c.raw("documents").select("doc_id", T.sanitize("text").alias("clean"))


@query("decision_key", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def decision_key(c):
    return c.raw("documents").select("doc_id", T.decision_key("text").alias("key"))


@query("requirement_name", """
    SELECT DISTINCT word, lower(CASE WHEN n = '' THEN word ELSE n END) AS name FROM (
      SELECT word, regexp_extract(word, '^\\s*([A-Za-z0-9_.-]+)', 1) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents))""")
def requirement_name(c):
    words = c.raw("documents").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.select("word", T.requirement_name("word").alias("name"))


@query("iso_date", f"SELECT repo_id, sha, left(authored_raw, 10) AS iso, {O.format_date('authored_raw')} AS shown FROM commits")
def iso_date(c):
    return c.commits().select("repo_id", "sha", T.iso_date("authored_raw").alias("iso"), T.format_date("authored_raw").alias("shown"))


@query("inclusive_days", """
    SELECT a.repo_id, a.sha, abs(date_diff('day', CAST(b.authored_date AS DATE), CAST(a.authored_date AS DATE))) + 1 AS days
    FROM commits a JOIN commits b ON a.repo_id = b.repo_id AND b.seq = 0""")
def inclusive_days(c):
    first = c.commits().filter("seq = 0").select("repo_id", F.col("authored_raw").alias("first_raw"))
    return c.commits().join(first, "repo_id").select("repo_id", "sha", T.inclusive_days("first_raw", "authored_raw").alias("days"))


@query("normalize_timestamp", """
    SELECT repo_id, sha, strftime(make_timestamp(authored_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS from_text,
      strftime(make_timestamp(authored_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS from_seconds FROM commits""")
def normalize_timestamp(c):
    seconds = F.floor(F.col("authored_ms") / 1000).cast("string")
    return c.commits().select("repo_id", "sha", T.normalize_timestamp("authored_raw").alias("from_text"), T.normalize_timestamp(seconds).alias("from_seconds"))


@query("percent_label", """
    SELECT repo_id, language, CASE WHEN share < 0.005 THEN '<1' ELSE CAST(CAST(floor(share * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS basis_label,
      CASE WHEN share < 0.01 THEN '<1' ELSE CAST(CAST(floor(share * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS overview_label
    FROM (SELECT repo_id, language, b / sum(b) OVER (PARTITION BY repo_id) AS share FROM (SELECT repo_id, language, sum(size) AS b FROM file_languages
      WHERE kind <> 'symlink' AND NOT """ + O.is_vendored() + """ AND language_type IN ('programming', 'markup') GROUP BY ALL))""")
def percent_label(c):
    from repochron.operators import metrics

    return metrics.language_shares(c.files()).select(
        "repo_id", "language", metrics.percent_label("share", 0.005).alias("basis_label"), metrics.percent_label("share", 0.01).alias("overview_label"))


# ---------------------------------------------------------------------- Markdown
_SECTIONS = {
    **_LINES,
    "fenced": """
        SELECT *, regexp_matches(line, '^\\s{0,3}(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\\s{0,3}(```|~~~)') THEN 1 ELSE 0 END)
          OVER (PARTITION BY repo_id, path ORDER BY n) AS f FROM doc_lines""",
    "headed": """
        SELECT *, NOT fence AND f % 2 = 0 AND regexp_matches(line, '^\\s{0,3}#{1,6}\\s') AS heading FROM fenced""",
    "section_lines": "SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path ORDER BY n) AS s FROM headed",
    "sections": f"""
        SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY s) - 1 AS pos FROM (
          SELECT repo_id, path, s, coalesce(max(len(regexp_extract(line, '^\\s{{0,3}}(#+)', 1))) FILTER (heading), 0) AS level,
            coalesce(max({O.strip_markdown("regexp_extract(line, '^\\s{0,3}#{1,6}\\s+(.*?)\\s*#*\\s*$', 1)")}) FILTER (heading), '') AS title,
            coalesce(max(n) FILTER (heading), 0) AS line,
            regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT heading), ''), '^\\s+|\\s+\\z', '', 'g') AS body
          FROM section_lines GROUP BY ALL) WHERE level > 0 OR body <> ''""",
}


@query("markdown_sections", "SELECT repo_id, path, pos, level, title, line, md5(body) AS body FROM sections", _SECTIONS)
def markdown_sections(c):
    return markdown.markdown_sections(c.bulk_documents()).withColumn("body", F.md5("body"))


@query("section_paragraph_and_items")
def section_paragraph_and_items(c):
    return markdown.section_paragraph_and_items(markdown.markdown_sections(c.bulk_documents()))


@query("heading_is_decision", f"""
    SELECT repo_id, path, pos, title, regexp_matches(title, {O.text(rules.DECISION_HEADING)})
      AND NOT (regexp_matches(title, '(?i)^why\\b') AND regexp_matches(title, {O.text(rules.READER_QUESTION)})) AS matched FROM sections WHERE level > 0""", _SECTIONS)
def heading_is_decision(c):
    return markdown.markdown_sections(c.bulk_documents()).filter("level > 0").select("repo_id", "path", "pos", "title", T.is_decision_heading("title").alias("matched"))


@query("document_decisions")
def document_decisions(c):
    return decisions.document_decisions(I.read_documents(c)).select("repo_id", "ord", "title", "detail", "basis", "date")


@query("document_decision_budget", """
    SELECT repo_id, path, found, used, greatest(0, least(found, 24 - used)) AS granted FROM (
      SELECT *, coalesce(sum(found) OVER (PARTITION BY repo_id ORDER BY doc_rank, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
        SELECT repo_id, path, CASE WHEN path LIKE 'docs/adr/%' THEN 0 WHEN path = 'README.md' THEN 2 ELSE 3 END AS doc_rank,
          CASE WHEN path = 'README.md' THEN 3 ELSE 1 END AS found FROM docs WHERE path = 'README.md' OR path LIKE 'docs/%'))""")
def document_decision_budget(c):
    return decisions.document_decision_budget(decisions.document_candidates(I.read_documents(c))).select("repo_id", "path", "found", "used", "granted")


# ---------------------------------------------------------------------- sentences of sessions and commits
_SPOKEN = {"said": f"""
    SELECT conv_id % 25 AS repo_id, conv_id AS session_id, turn * 3 AS pos, role, s AS sentence FROM (
      SELECT *, ({O.items(CORPUS.SENTENCES)})[CAST((conv_id * 7 + turn) % 9 AS INT) + 1] AS s FROM turns) WHERE s <> ''"""}
_DECIDES = (f"(NOT regexp_matches(sentence, '[:?]\\z') AND (regexp_matches(sentence, {O.text(rules.CHOICE_PHRASE)})"
            f" OR (regexp_matches(sentence, {O.text(rules.COMPARISON_PHRASE)}) AND regexp_matches(sentence, {O.text(rules.ACTION_WORD)}))))")
_DEBUGS = f"(NOT regexp_matches(sentence, '[:?]\\z') AND regexp_matches(sentence, {O.text(rules.DEBUGGING_PHRASE)}))"


def _spoken(c):
    return sessions.spoken(c.session_events())


@query("sentence_states_decision", f"SELECT repo_id, session_id, pos, sentence FROM said WHERE {_DECIDES}", _SPOKEN)
def sentence_states_decision(c):
    return _spoken(c).filter(T.states_decision("sentence")).select("repo_id", "session_id", "pos", "sentence")


@query("sentence_debugging_note", f"SELECT repo_id, session_id, pos, sentence FROM said WHERE {_DEBUGS}", _SPOKEN)
def sentence_debugging_note(c):
    return _spoken(c).filter(T.is_debugging_note("sentence")).select("repo_id", "session_id", "pos", "sentence")


@query("sentence_rationale", f"""
    SELECT repo_id, sha, s AS sentence, len(s) >= 20 AND regexp_matches(s, {O.text(rules.RATIONALE)}) AS matched
    FROM (SELECT repo_id, sha, replace(body, chr(10), ' ') AS s FROM commits WHERE body <> '')""")
def sentence_rationale(c):
    return c.commits().select("repo_id", "sha", F.explode(T.sentences("body")).alias("sentence")).select(
        "repo_id", "sha", "sentence", T.has_rationale("sentence").alias("matched"))


_ACCEPTED = {**_SPOKEN, "accepted": f"""
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY session_id, pos) AS ord FROM (
      SELECT * FROM said WHERE {_DECIDES} QUALIFY row_number() OVER (PARTITION BY repo_id, sentence ORDER BY session_id, pos) = 1) QUALIFY ord <= 12"""}


@query("per_message_cap", "SELECT repo_id, ord, session_id, pos, sentence FROM accepted", _ACCEPTED)
def per_message_cap(c):
    return sessions.accepted_sentences(sessions.decision_sentences(c.session_events())).select("repo_id", "ord", "session_id", "pos", "sentence")


@query("session_decisions", """
    SELECT repo_id, ord, sentence AS title, 'Development session `session-' || session_id || '.jsonl`, line ' || (pos + 1) || ' (' || role || ')' AS basis,
      strftime(TIMESTAMP '2024-01-01' + to_days(CAST(session_id AS INT)) + to_minutes(10 * (pos // 3)), '%Y-%m-%d') AS date FROM accepted""", _ACCEPTED)
def session_decisions(c):
    return sessions.session_decisions(c.session_events()).select("repo_id", "ord", "title", "basis", "date")


# ---------------------------------------------------------------------- commands
_PURPOSE_SQL = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN regexp_matches(command, {O.text(p.replace('(?! format)', '( [^f]|[^ ]|$)'))}) THEN '{n}' END" for n, p in rules.PURPOSES) + ")"


@query("command_purposes", f"SELECT session_id, pos, command, {_PURPOSE_SQL} AS purposes FROM session_events WHERE command IS NOT NULL")
def command_purposes(c):
    commands = c.session_events().filter("command is not null").withColumn("text_", S.expanded_text("command", S.no_scripts()))
    return commands.select("session_id", "pos", "command", I.joined(S.purposes_of_text("text_"), " ").alias("purposes"))


@query("command_is_plumbing", f"SELECT session_id, pos, command, regexp_matches(command, {O.text(rules.SHELL_PLUMBING)}) AS plumbing FROM session_events WHERE command IS NOT NULL")
def command_is_plumbing(c):
    return c.session_events().filter("command is not null").select("session_id", "pos", "command", S.is_plumbing("command").alias("plumbing"))


_KEYS = {"command_keys": "SELECT * FROM (VALUES (0, 0, 'bun test test/a.test.ts 2>&1', 'bun test'), (0, 1, 'tail -5', 'tail -5'), (1, 0, 'CI=1 timeout 60 bunx tsc --noEmit', 'bunx tsc --noEmit'),"
         " (2, 0, 'cd /tmp', NULL), (2, 1, 'cargo test', 'cargo test'), (3, 0, 'echo ok', NULL)) v(which, seg_pos, segment, key)"}


@query("command_segments", "SELECT session_id, pos, seg_pos, segment FROM session_events JOIN command_keys ON which = (pos // 3) % 4 WHERE command IS NOT NULL", _KEYS)
def command_segments(c):
    return c.session_events().filter("command is not null").select("session_id", "pos", F.posexplode(S.segments("command")).alias("seg_pos", "segment")).withColumn(
        "seg_pos", F.col("seg_pos").cast("long"))


@query("command_key", "SELECT session_id, pos, segment, key FROM session_events JOIN command_keys ON which = (pos // 3) % 4 WHERE command IS NOT NULL", _KEYS)
def command_key(c):
    return c.session_events().filter("command is not null").select("session_id", "pos", F.explode(S.segments("command")).alias("segment")).withColumn(
        "key", S.command_key("segment"))


@query("test_summary_line", """
    SELECT session_id, id, CASE WHEN text LIKE '12 pass%' THEN '12 pass, 0 fail' WHEN text LIKE 'test result%' THEN '7 passed, 0 failed' END AS summary
    FROM session_events WHERE kind = 'result'""")
def test_summary_line(c):
    return c.session_events().filter("kind = 'result'").select("session_id", "id", S.test_summary("text").alias("summary"))


# ---------------------------------------------------------------------- session figures
@query("session_summary", """
    SELECT repo_id, session_id, file, count(*) AS events, count(*) FILTER (kind = 'command') AS commands, min(ts) AS first_timestamp, max(ts) AS last_timestamp
    FROM session_events GROUP BY ALL""")
def session_summary(c):
    return sessions.session_summary(c.session_events()).drop("warnings", "first_event")


@query("session_commands", """
    SELECT repo_id, session_id, key AS command, n, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, session_id ORDER BY n DESC, first_pos, key) AS rank FROM (
        SELECT repo_id, session_id, key, count(DISTINCT pos) AS n, min(pos) AS first_pos FROM session_events JOIN command_keys ON which = (pos // 3) % 4
        WHERE command IS NOT NULL AND key IN ('bun test', 'bunx tsc --noEmit', 'cargo test') GROUP BY ALL)) WHERE rank <= 4""", _KEYS)
def session_commands(c):
    return sessions.session_commands(c.session_events()).select("repo_id", "session_id", F.col("key").alias("command"), "n", "rank")


@query("session_test_runs", """
    SELECT repo_id, session_id, count(*) AS runs, arg_max(CASE WHEN text LIKE '12 pass%' THEN '12 pass, 0 fail' ELSE '7 passed, 0 failed' END, pos) AS last_summary
    FROM session_events WHERE kind = 'result' AND text <> 'done' GROUP BY ALL""")
def session_test_runs(c):
    return sessions.session_test_runs(c.session_events()).select("repo_id", "session_id", "runs", "last_summary")


_NOTES = f"""
    SELECT repo_id, session_id, pos, sentence, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rank FROM said WHERE {_DEBUGS}) WHERE rank <= 5"""


@query("session_debug_notes", _NOTES, _SPOKEN)
def session_debug_notes(c):
    return sessions.session_debug_notes(c.session_events()).select("repo_id", "session_id", "pos", "sentence", "rank")


@query("session_debugging", f"SELECT repo_id, session_id, 'Debugging note from `session-' || session_id || '.jsonl`: “' || sentence || '”' AS text FROM ({_NOTES})", _SPOKEN)
def session_debugging(c):
    return sessions.debugging_findings(c.session_events()).select("repo_id", "session_id", "text")


@query("plural", f"SELECT o_orderkey, {O.plural('o_orderkey % 3', 'directory', 'directories')} AS counted FROM orders")
def plural(c):
    return c.raw("orders").select("o_orderkey", T.plural(F.col("o_orderkey") % 3, "directory", "directories").alias("counted"))


@query("format_date", f"SELECT repo_id, sha, {O.format_date('authored_raw')} AS shown FROM commits")
def format_date(c):
    return c.commits().select("repo_id", "sha", T.format_date("authored_raw").alias("shown"))
