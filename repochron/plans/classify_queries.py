"""Queries over paths, commits and tags (classification, predicates, semi and anti joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from repochron import rules
from repochron.functions import commits as C
from repochron.functions import paths as P
from repochron.functions import text as T
from repochron.operators import commits as K
from repochron.operators import documents as D
from repochron.operators import ranking
from repochron.plans import oracle_corpus as O
from repochron.plans.registry import query


def _path_query(key: str, spark_columns, sql_columns: dict) -> None:
    sql = ", ".join(f"{expr} AS {name}" for name, expr in sql_columns.items())
    oracle = f"SELECT path, {sql} FROM (SELECT DISTINCT path FROM changes)"

    @query(key, oracle)
    def build(corpus):
        return corpus.changes().select("path").distinct().select("path", *[c.alias(n) for n, c in spark_columns().items()])


_path_query("path_is_test", lambda: {"is_test": P.is_test("path")}, {"is_test": O.is_test()})
_path_query("path_is_test_source", lambda: {"is_test_source": P.is_test_source("path")}, {"is_test_source": O.is_test_source()})
_path_query("path_is_documentation", lambda: {"is_documentation": P.is_documentation("path")}, {"is_documentation": O.is_doc()})
_path_query("path_doc_role", lambda: {"doc_role": P.doc_role("path")}, {"doc_role": (
    f"CASE WHEN regexp_matches(path, {O.text(rules.ROOT_README)}) THEN 'readme'"
    f" WHEN regexp_matches(path, {O.text(rules.DECISION_RECORD)}) THEN 'decision-record'"
    f" WHEN regexp_matches({O.base()}, {O.text(rules.ASSISTANT_GUIDE)}) THEN 'assistant-guide'"
    f" WHEN len(string_split(path, '/')) <= 2 AND {O.any_match(O.base(), [p for p, _ in rules.NOTABLE_GUIDES])} THEN 'guide' END")})
_path_query("path_ci_system", lambda: {"ci_system": P.ci_system("path")}, {"ci_system": O.ci_system()})
_path_query("path_is_lockfile", lambda: {"is_lockfile": P.is_lockfile("path")}, {"is_lockfile": O.is_lockfile()})
_path_query("path_is_vendored", lambda: {"is_vendored": P.is_vendored("path")}, {"is_vendored": O.is_vendored()})
_path_query("path_is_sensitive", lambda: {"is_sensitive": P.is_sensitive("path")}, {"is_sensitive": O.is_sensitive()})
_path_query("path_area", lambda: {"area": P.area("path"), "topic": P.topic_key(P.area("path"))}, {"area": O.area(), "topic": O.topic_key(O.area())})
_path_query("path_parts", lambda: {
    "base_name": P.base_name("path"), "directory": P.directory("path"), "extension": P.extension("path"), "depth": P.depth("path").cast("long"),
}, {"base_name": O.base(), "directory": "CASE WHEN contains(path, '/') THEN left(path, len(path) - len(" + O.base() + ") - 1) ELSE '' END",
    "extension": O.extension(), "depth": "CAST(len(string_split(path, '/')) - 1 AS BIGINT)"})
_path_query("path_is_benchmark", lambda: {"is_benchmark": P.is_benchmark("path")},
            {"is_benchmark": f"(regexp_matches(path, {O.text(rules.BENCH_DIRECTORY)}) OR regexp_matches(path, {O.text(rules.BENCH_NAME)}))"})
_path_query("path_is_manifest", lambda: {"is_manifest": P.is_manifest("path")}, {"is_manifest": O.is_manifest()})


@query("path_language", """
    SELECT DISTINCT c.path, coalesce(a.language, b.language) AS language, coalesce(a.language_type, b.language_type) AS language_type
    FROM (SELECT DISTINCT path, regexp_extract(regexp_extract(path, '[^/]*\\z'), '^.+\\.([^.]*)\\z', 1) AS e FROM changes) c
      LEFT JOIN languages a ON a.ext = c.e LEFT JOIN languages b ON b.ext = lower(c.e)""")
def path_language(corpus):
    return corpus.changes().select("path").distinct().select(
        "path", P.language("path").alias("language"), P.language_type("path").alias("language_type"))


@query("author_is_automated", f"""
    SELECT repo_id, sha, author_name, regexp_matches(trim(author_name), {O.text(rules.AUTOMATED_AUTHOR)}) AS automated FROM commits""")
def author_is_automated(corpus):
    return corpus.commits().select("repo_id", "sha", "author_name", C.is_automated("author_name").alias("automated"))


@query("commit_classify", "SELECT repo_id, sha, kind, source, scope, breaking FROM summaries")
def commit_classify(corpus):
    return K.commit_summaries(corpus.commits(), corpus.changes()).select("repo_id", "sha", "kind", "source", "scope", "breaking")


@query("commit_kind_from_changes", "SELECT repo_id, sha, changes_kind AS kind FROM change_facts")
def commit_kind_from_changes(corpus):
    return K.change_facts(corpus.changes()).select("repo_id", "sha", K.kind_from_changes().alias("kind"))


@query("commit_subject_text", f"""
    SELECT repo_id, sha, {O.subject_text()} AS subject_text,
      regexp_replace({O.subject_text()}, {O.text(rules.AREA_PREFIX_STRIP)}, '') AS decision_text FROM commits""")
def commit_subject_text(corpus):
    return corpus.commits().select(
        "repo_id", "sha", C.subject_text("subject").alias("subject_text"), C.decision_text("subject").alias("decision_text"))


@query("commit_is_release_bookkeeping", "SELECT repo_id, sha, bookkeeping FROM riding")
def commit_is_release_bookkeeping(corpus):
    people = K.people(K.commit_summaries(corpus.commits(), corpus.changes()))
    return people.select("repo_id", "sha", C.is_release_bookkeeping("kind", "scope", "subject").alias("bookkeeping"))


@query("commit_rides_along", "SELECT repo_id, sha, rides FROM riding")
def commit_rides_along(corpus):
    people = K.people(K.commit_summaries(corpus.commits(), corpus.changes()))
    return K.with_riding(people, corpus.tags()).select("repo_id", "sha", "rides")


@query("tag_release_weight", "SELECT repo_id, name, sha, weight FROM weighted_tags")
def tag_release_weight(corpus):
    return corpus.tags().select("repo_id", "name", "sha", C.release_weight("name").alias("weight"))


@query("tags_reachable", """
    SELECT repo_id, name, sha, weight FROM weighted_tags t WHERE EXISTS (
      SELECT 1 FROM commits c WHERE c.repo_id = t.repo_id AND c.sha = t.sha)""")
def tags_reachable(corpus):
    return K.reachable_tags(corpus.all_tags(), corpus.commits()).select("repo_id", "name", "sha", "weight")


@query("select_documents", "SELECT repo_id, path, priority, outcome FROM selection")
def select_documents(corpus):
    return D.select_documents(corpus.files()).select("repo_id", "path", "priority", "outcome")


@query("documents_with_blobs", "SELECT repo_id, path, text FROM docs")
def documents_with_blobs(corpus):
    return D.documents(corpus.files(), corpus.blobs()).select("repo_id", "path", "text")


@query("commit_states_choice", f"""
    SELECT repo_id, sha, NOT only_docs AND NOT regexp_matches(subject, {O.text(rules.TYPO_WORD)})
      AND {O.any_match(f"regexp_replace({O.subject_text()}, {O.text(rules.AREA_PREFIX_STRIP)}, '')", rules.EXPLICIT_CHOICE_SUBJECTS)} AS states_choice
    FROM summaries""")
def commit_states_choice(corpus):
    summaries = K.commit_summaries(corpus.commits(), corpus.changes())
    return summaries.select("repo_id", "sha", C.states_choice("subject", "only_docs").alias("states_choice"))


@query("people_commits", "SELECT repo_id, sha, author_name FROM people")
def people_commits(corpus):
    return K.people(K.commit_summaries(corpus.commits(), corpus.changes())).select("repo_id", "sha", "author_name")


@query("commit_line_counts", "SELECT repo_id, sha, files_changed, additions, deletions FROM change_facts")
def commit_line_counts(corpus):
    return K.change_facts(corpus.changes()).select("repo_id", "sha", "files_changed", "additions", "deletions")


@query("commit_sequence", """
    SELECT repo_id, sha, row_number() OVER (PARTITION BY repo_id ORDER BY log_pos DESC) - 1 AS seq
    FROM (SELECT repo_id, sha, row_number() OVER (PARTITION BY repo_id ORDER BY local_ts DESC, k DESC) AS log_pos
      FROM (SELECT repo_id, k, local_ts, sha256(CAST(k AS VARCHAR)) AS sha FROM keyed))""")
def commit_sequence(corpus):
    commits = corpus.commits()
    last = commits.groupBy("repo_id").agg(F.max("seq").alias("last"))
    log = commits.join(last, "repo_id").select("repo_id", "sha", (F.col("last") - F.col("seq") + 1).alias("log_pos"))
    ordered = ranking.number_rows(log, ["repo_id"], -ranking.block_of("log_pos"), [F.col("log_pos").desc()], "n")
    return ordered.select("repo_id", "sha", (F.col("n") - 1).alias("seq"))


@query("commit_topics", "SELECT repo_id, sha, topic, round(weight, 9) AS weight FROM topics")
def commit_topics(corpus):
    changes = corpus.changes()
    return K.commit_topics(K.commit_summaries(corpus.commits(), changes), changes).select(
        "repo_id", "sha", "topic", F.round("weight", 9).alias("weight"))
