"""Queries over sources, evidence and the assembled case study."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repochron.operators import decisions as DEC
from repochron.operators import evidence as E
from repochron.operators import practice
from repochron.operators import study as ST
from repochron.plans import exports as X
from repochron.plans import fact_queries as FQ
from repochron.plans import inputs as I
from repochron.plans import milestone_queries as MQ
from repochron.plans import oracle_corpus as O
from repochron.plans import text_queries as TQ
from repochron.plans.registry import query
from repochron.session import shared_folder, stage
from repochron.sources import git_exports, text_files, transcripts
from repochron.streaming import sessions as stream

# ---------------------------------------------------------------------- scans


@query("scan_commit_log", """
    SELECT c.repo_id, c.sha, c.short_sha, c.seq, CAST(n_parents AS BIGINT) AS n_parents, author_name, authored_raw, subject, body, coalesce(f.files, 0) AS files, coalesce(f.digest, '') AS digest
    FROM commits c LEFT JOIN (SELECT repo_id, sha, count(*) AS files,
        string_agg(path || ':' || status || ':' || coalesce(previous_path, '') || ':' || coalesce(CAST(additions AS VARCHAR), '-') || ':' || coalesce(CAST(deletions AS VARCHAR), '-'), ' ' ORDER BY pos, path) AS digest
      FROM changes GROUP BY ALL) f USING (repo_id, sha)""")
def scan_commit_log(c):
    count = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    words = F.transform("changes", lambda x: F.concat_ws(":", x["path"], x["status"], F.coalesce(x["previous_path"], F.lit("")), count(x["additions"]), count(x["deletions"])))
    folder = f"{shared_folder(c.spark)}/logs-{uuid.uuid4().hex}"
    X.log_dumps(c).withColumn("content", F.col("content").cast("string")).write.partitionBy("repo_id", "part").text(folder, compression="gzip")
    records = git_exports.read_records(c.spark, folder, place=r"repo_id=(\d+)/part=(\d+)/", glob="*.txt.gz")
    return git_exports.scan_commit_log(records).select(
        "repo_id", "sha", "short_sha", "seq", F.col("n_parents").cast("long").alias("n_parents"), "author_name", "authored_raw", "subject", "body",
        F.size("changes").cast("long").alias("files"), F.array_join(words, " ").alias("digest"))


@query("scan_tree", "SELECT repo_id, path, size, object_id, kind FROM files")
def scan_tree(c):
    return git_exports.scan_tree(X.tree_listings(c))


@query("scan_tags", "SELECT repo_id, name, sha FROM tags")
def scan_tags(c):
    return git_exports.scan_tags(X.tag_listings(c))


@query("scan_text_files", """
    SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 = 0 THEN 'binary' END AS reason FROM documents""")
def scan_text_files(c):
    return text_files.scan_text_files(X.content_files(c))


@query("scan_sessions", """
    SELECT 'session-' || s || e AS file, CASE e WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'jsonl' WHEN '.NDJSON' THEN 'jsonl' ELSE 'text' END AS format,
      CASE WHEN conv_id % 17 = 0 THEN 'too-large' WHEN first_kb THEN 'binary' END AS reject_reason
    FROM (SELECT conv_id, conv_id * 1000000 + turn // 200 AS s, (['.json', '.jsonl', '.NDJSON', '.md', '.txt'])[CAST(conv_id % 5 AS INT) + 1] AS e,
        conv_id % 13 = 0 AND false AS first_kb FROM turns GROUP BY ALL)""".replace("conv_id % 13 = 0 AND false", "conv_id % 13 = 0"))
def scan_sessions(c):
    # The binary probe looks at the first 8,192 bytes, so the NUL is put in front for this check.
    files = X.session_files(c)
    probe = F.when(F.substring("content", -1, 1) == F.lit(b"\x00"), F.concat(F.lit(b"\x00"), F.col("content"))).otherwise(F.col("content"))
    return text_files.scan_sessions(files.withColumn("content", probe)).select("file", "format", "reject_reason")


_JSONL = {"jsonl_lines": """
    SELECT conv_id * 1000000 + turn // 200 AS session_id, turn, role, text, kind,
      row_number() OVER (PARTITION BY conv_id, turn // 200 ORDER BY turn, kind) AS line
    FROM turns, (VALUES (0), (1), (2)) v(kind) WHERE kind = 0 OR (kind = 1 AND turn % 5 = 4) OR (kind = 2 AND turn % 3 = 2)"""}
_WARN = """
    SELECT session_id, 'Skipped ' || n || CASE WHEN n = 1 THEN ' line that is' ELSE ' lines that are' END || ' not valid JSON (line' || CASE WHEN n = 1 THEN ' ' ELSE 's ' END
      || array_to_string(l[1:5], ', ') || CASE WHEN n > 5 THEN ', …' ELSE '' END || ').' AS warning
    FROM (SELECT session_id, count(*) AS n, list(line ORDER BY line) AS l FROM jsonl_lines WHERE kind = 1 GROUP BY ALL)"""


@query("scan_session_jsonl", f"""
    SELECT j.session_id, j.line AS pos, CASE WHEN turn % 2 = 0 THEN 'm' || turn ELSE 'u' || turn END AS id, w.warning
    FROM jsonl_lines j LEFT JOIN ({_WARN}) w USING (session_id) WHERE kind = 0""", _JSONL)
def scan_session_jsonl(c):
    scanned = transcripts.scan_session_jsonl(X.jsonl_sessions(c))
    identifier = F.coalesce(F.try_variant_get("entry", "$.id", "string"), F.try_variant_get("entry", "$.uuid", "string"))
    warnings = transcripts.jsonl_warnings(scanned).select("session_id", "warning")
    return scanned.filter("entry is not null").select("session_id", "pos", identifier.alias("id")).join(warnings, "session_id", "left")


@query("scan_session_json", """
    SELECT conv_id * 1000000 + turn // 200 AS session_id, turn % 200 + 1 AS pos, CASE WHEN turn % 2 = 0 THEN 'm' || turn ELSE 'u' || turn END AS id FROM turns""")
def scan_session_json(c):
    identifier = F.coalesce(F.try_variant_get("entry", "$.id", "string"), F.try_variant_get("entry", "$.uuid", "string"))
    return transcripts.scan_session_json(X.json_sessions(c)).select("session_id", "pos", identifier.alias("id"))


@query("session_entries", """
    SELECT conv_id * 1000000 + turn // 200 AS session_id, CASE WHEN turn % 2 = 0 THEN 'm' || turn WHEN o = 0 THEN 'u' || turn ELSE 'u' || turn || ':part1' END AS id,
      CASE o WHEN 0 THEN 'message' ELSE 'command' END AS kind, role,
      CASE WHEN turn % 2 = 0 THEN strftime(make_timestamp((1700000000 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS ts,
      CASE WHEN o = 1 THEN 'bun test' WHEN turn % 2 = 0 THEN text ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS text, CASE o WHEN 1 THEN 'bun test' END AS command, CASE o WHEN 1 THEN 'bash' END AS tool
    FROM turns, (VALUES (0), (1)) v(o) WHERE o = 0 OR turn % 2 = 1""")
def session_entries(c):
    return transcripts.session_entries(transcripts.scan_session_json(X.json_sessions(c))).drop("pos")


@query("session_turns")
def session_turns(c):
    return transcripts.session_turns(X.text_sessions(c))


@query("scan_session_text", """
    SELECT conv_id * 1000000 + turn // 200 AS session_id, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role,
      count(*) AS messages, count(*) FILTER (turn % 4 = 0) AS commands, count(*) FILTER (turn % 4 = 0) AS results FROM turns GROUP BY ALL""")
def scan_session_text(c):
    events = transcripts.session_turns(X.text_sessions(c))
    return events.groupBy("session_id", "role").agg(*[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("message", "command", "result")])


@query("stream_session_events", """
    SELECT CAST(conv_id AS BIGINT) AS session_id, count(*) AS events, count(*) FILTER (turn % 4 = 1) AS commands,
      strftime(make_timestamp((1700000000 + min(turn) * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS first_timestamp,
      strftime(make_timestamp((1700000000 + max(turn) * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS last_timestamp FROM turns GROUP BY conv_id""")
def stream_session_events(c):
    folder = f"{shared_folder(c.spark)}/stream-{uuid.uuid4().hex}"
    X.stream_lines(c).write.text(f"{folder}/in")
    stream.run_available(c.spark, f"{folder}/in", f"{folder}/state", f"{folder}/rejects", f"{folder}/summary")
    return stream.read_summary(c.spark, f"{folder}/summary")


# ---------------------------------------------------------------------- evidence on given drafts
def _tag_uses(c):
    """Every tag is recorded twice: once by position, once again much later."""
    item = E.drafts(practice.tag_draft(F.col("name"), F.col("sha")))
    rows = c.tags().select("repo_id", F.explode(F.array(F.col("pos"), F.col("pos") + (1 << 40))).alias("ord"), item.alias("drafts"))
    return E.explode_drafts(rows, "ord")


_TAGS = {"tag_evidence": "SELECT repo_id, 'E' || row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS id, 'Tag `' || name || '` points at `' || left(sha, 7) || '`.' AS statement, name, pos FROM tags"}


@query("evidence_numbering", "SELECT repo_id, id, 'observed' AS level, statement, name FROM tag_evidence", _TAGS)
def evidence_numbering(c):
    return E.number_evidence(_tag_uses(c)).select("repo_id", "id", "level", "statement", F.col("source.name").alias("name"))


@query("evidence_distinct", "SELECT repo_id, statement, pos * 64 AS first_ord FROM tag_evidence", _TAGS)
def evidence_distinct(c):
    return E.number_evidence(_tag_uses(c)).select("repo_id", "statement", F.col("ord").alias("first_ord"))


@query("evidence_refs", "SELECT repo_id, id, (pos + o) * 64 AS ord FROM tag_evidence, (VALUES (0), (1099511627776)) v(o)", _TAGS)
def evidence_refs(c):
    uses = stage(_tag_uses(c))
    return E.references(uses, E.number_evidence(uses)).select("repo_id", "id", "ord")


@query("evidence_integrity", "SELECT repo_id, name AS key, name AS problem FROM tags WHERE false")
def evidence_integrity(c):
    return I.study(c).integrity


# ---------------------------------------------------------------------- decisions of all kinds
_ALL = {**FQ.EXTRA, **MQ.X, **TQ._ACCEPTED, "document_rows": f"""
    SELECT repo_id, title, row_number() OVER (PARTITION BY repo_id ORDER BY doc_rank, path, item) AS ord FROM (
      SELECT repo_id, path, 0 AS item, 'Use option ' || regexp_extract(path, '(\\d+)', 1) AS title, 0 AS doc_rank FROM docs WHERE path LIKE 'docs/adr/%'
      UNION ALL SELECT repo_id, path, item, title, 2 FROM docs, (VALUES (0, 'Plain files'), (1, 'One pass'), (2, 'Why Rust?')) v(item, title) WHERE path = 'README.md'
      UNION ALL SELECT repo_id, path, 0, 'Trade-offs', 3 FROM docs WHERE path LIKE 'docs/%' AND path NOT LIKE 'docs/adr/%')
    QUALIFY ord <= 24""", "tooling_rows": """
    SELECT repo_id, title, row_number() OVER (PARTITION BY repo_id ORDER BY idx, phase, marker_pos) AS ord FROM (
      SELECT repo_id, 'Moved from ' || from_tool || ' to ' || to_tool AS title, least(removed_seq, added_seq) AS idx, 0 AS phase, from_pos AS marker_pos FROM migrations
      UNION ALL SELECT repo_id, CASE event WHEN 'stopped' THEN 'Stopped using ' ELSE 'Adopted ' END || tool, idx, phase, marker_pos FROM events_of_tools) QUALIFY ord <= 10""",
    "all_decisions": f"""
    SELECT repo_id, title, status, 'D' || row_number() OVER (PARTITION BY repo_id ORDER BY section, ord) AS id, section FROM (
      SELECT repo_id, title, 'documented' AS status, 0 AS section, ord FROM document_rows
      UNION ALL SELECT repo_id, upper(left(t, 1)) || substr(t, 2), 'documented', 1, seq FROM (SELECT repo_id, seq, {O.subject_text()} AS t FROM commit_decision_rows)
      UNION ALL SELECT repo_id, sentence, 'documented', 2, ord FROM accepted
      UNION ALL SELECT repo_id, title, 'inferred', 3, ord FROM tooling_rows)"""}


@query("decision_union", "SELECT repo_id, id, title, status, section AS section_ord FROM all_decisions", _ALL)
def decision_union(c):
    return I.study(c).decisions.select("repo_id", "id", "title", "status", F.col("section_ord").cast("long").alias("section_ord"))


@query("decisions")
def decisions(c):
    s = I.study(c)
    return s.with_evidence("decisions", ["repo_id", "id"]).select("repo_id", "id", "title", "status", "detail", "basis", "date", I.joined("evidence", " ").alias("evidence"))


@query("document_decision_titles", "SELECT repo_id, ord, title FROM document_rows", _ALL)
def document_decision_titles(c):
    return DEC.document_decisions(I.read_documents(c)).select("repo_id", "ord", "title")


# ---------------------------------------------------------------------- the study
@query("finding_union")
def finding_union(c):
    return I.study(c).findings.select("repo_id", "area", "area_ord", "ord", "text")


@query("findings")
def findings(c):
    s = I.study(c)
    return s.with_evidence("findings", ["repo_id", "ord"]).select("repo_id", "area", "text", "level", I.joined("evidence", " ").alias("evidence"))


@query("overview")
def overview(c):
    s = I.study(c)
    return s.with_evidence("overview", ["repo_id", "ord"]).select("repo_id", "ord", "text", "level", I.joined("evidence", " ").alias("evidence"))


_LIMITS = [
    ("'The history reachable from HEAD' || CASE WHEN branch IS NOT NULL THEN ' (`' || branch || '`)' ELSE '' END || ' was read only; other branches and unpushed work elsewhere are not included.'", "true"),
    (O.text("The project was not built, its tests were not run, and CI was not executed. Statements about tests and CI describe what is configured, not whether it passes."), "true"),
    (O.text("Line counts exclude lockfiles, binary files, merge commits, and automated commits. Dates are author dates as recorded, which rebases can rewrite."), "true"),
    (O.text("Contributors are counted by author name, so one person committing under several names counts more than once."), "true"),
    (O.text("Languages are classified by file extension. Milestone grouping and some commit types are inferences and are marked as such."), "true"),
    (O.text("Only tracked metadata, CI configuration, and documentation files were read; source code contents were not inspected."), "true"),
    (O.plural("bots", "commit") + " || ' by automation accounts (' || " + O.join_words("names") + " || ') were recognized by author name and left out of activity figures, milestones, and selected commits."
     " They are still listed in the commit table.'", "bots > 0 AND bots < commits"),
    (O.text("Rust unit tests written inside source files are not counted; test figures cover only separate test files, such as those under `tests/`."), "tests > 0 AND rust"),
    (O.text("No test files were detected by naming convention; tests embedded in source files (for example Rust unit tests) are not counted."), "tests = 0"),
    (O.text("No CI configuration was found among tracked files."), "ci = 0"),
    (O.text("No development sessions were supplied, so decision rationale is limited to documentation and commit messages."), "sessions = 0"),
    (O.plural("skipped", "metadata or documentation file") + " || CASE WHEN skipped = 1 THEN ' was' ELSE ' were' END || ' not read (' || " + O.join_words("reasons") + " || ').'", "skipped > 0"),
]


_LIMIT_ROWS = "SELECT repo_id, text FROM (" + " UNION ALL ".join(f"SELECT repo_id, {text} AS text FROM limit_facts WHERE {when}" for text, when in _LIMITS) + ")"
_LIMIT_FACTS = {
    **FQ.EXTRA, "limit_facts": f"""
    SELECT r.repo_id, r.branch, (SELECT count(*) FROM summaries s WHERE s.repo_id = r.repo_id) AS commits, (SELECT count(*) FROM summaries s WHERE s.repo_id = r.repo_id AND automated) AS bots,
      (SELECT list('`' || a || '`' ORDER BY a) FROM (SELECT DISTINCT repo_id, author_name AS a FROM summaries WHERE automated) s WHERE s.repo_id = r.repo_id) AS names,
      (SELECT count(*) FROM own f WHERE f.repo_id = r.repo_id AND {O.is_test_source()}) AS tests, (SELECT count(*) FROM own f WHERE f.repo_id = r.repo_id AND ends_with(path, '.rs')) > 0 AS rust,
      (SELECT count(*) FROM own f WHERE f.repo_id = r.repo_id AND {O.ci_system()} IS NOT NULL) AS ci,
      (SELECT count(DISTINCT conv_id) FROM conversations c WHERE c.conv_id % 25 = r.repo_id) AS sessions,
      (SELECT count(*) FROM selection x WHERE x.repo_id = r.repo_id AND outcome IN ('symlink', 'too-large')) AS skipped,
      (SELECT list(DISTINCT replace(outcome, '-', ' ') ORDER BY replace(outcome, '-', ' ')) FROM selection x WHERE x.repo_id = r.repo_id AND outcome IN ('symlink', 'too-large')) AS reasons
    FROM repos r"""}


@query("limitations", _LIMIT_ROWS, _LIMIT_FACTS)
def limitations(c):
    return I.study(c).limitations.select("repo_id", "text")


@query("evidence_counts")
def evidence_counts(c):
    return ST.evidence_counts(I.study(c))


@query("evidence_appendix")
def evidence_appendix(c):
    return E.appendix(I.study(c).evidence)


@query("case_study")
def case_study(c):
    study = I.study(c).case_study
    return study.select("repo_id", F.to_json(F.struct(*[x for x in study.columns if x != "repo_id"])).alias("study"))


@query("case_study_json", "SELECT repo_id, seq AS pos, sha, kind, source, subject, additions FROM summaries")
def case_study_json(c):
    """Report records written as JSON per repository and read back; the commit section is compared."""
    folder = f"{shared_folder(c.spark)}/json-{uuid.uuid4().hex}"
    I.study(c).write_json(folder)
    commits = ST.read_records(c.spark, folder).filter("section = 'commits'")
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return commits.select("repo_id", "pos", *[field(n).alias(n) for n in ("sha", "kind", "source", "subject")], field("additions").cast("long").alias("additions"))


@query("write_tables", """
    SELECT r.repo_id, s.commits, s.merges, (SELECT count(*) FROM people p WHERE p.repo_id = r.repo_id) AS members, (SELECT count(*) FROM all_decisions d WHERE d.repo_id = r.repo_id) AS decisions,
      (SELECT count(*) FROM limit_rows l WHERE l.repo_id = r.repo_id) AS limitations, (SELECT count(DISTINCT conv_id) FROM conversations c WHERE c.conv_id % 25 = r.repo_id) AS sessions
    FROM repos r JOIN (SELECT repo_id, count(*) AS commits, count(*) FILTER (is_merge) AS merges FROM summaries GROUP BY ALL) s USING (repo_id)""", {**_ALL, **_LIMIT_FACTS, "limit_rows": _LIMIT_ROWS})
def write_tables(c):
    """All result tables written partitioned by repository and read back: rows of each repository in five of them."""
    folder = f"{shared_folder(c.spark)}/tables-{uuid.uuid4().hex}"
    I.study(c).write_tables(folder)
    repo = F.col("repo_id").cast("long").alias("repo_id")
    counted = ST.read_table(c.spark, folder, "summaries").groupBy(repo).agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_merge").alias("merges"))
    for table, name in (("members", "members"), ("decisions", "decisions"), ("limitations", "limitations"), ("session_summaries", "sessions")):
        rows = ST.read_table(c.spark, folder, table).groupBy(repo).agg(F.count(F.lit(1)).alias(name))
        counted = counted.join(rows, "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return counted
