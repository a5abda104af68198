"""A whole study of one small history whose results are known, and faults planted in evidence."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from repochron.operators import evidence as E
from repochron.operators.study import Study, evidence_counts

README = "# Tool\n\nReads logs and prints tables.\n\n## Usage\n\nRun it.\n"
RECORD = "# 1. Use Parquet files\n\nDate: 2024-01-02\n\n## Status\n\nAccepted\n\n## Decision\n\nResults are kept in Parquet files because they are columnar.\n"


def _commit(seq, when, author, subject, body=""):
    at = datetime.fromisoformat(when.replace("Z", "+00:00")).astimezone(timezone.utc)
    sha = "abcd"[seq] * 40
    return (1, sha, sha[:7], seq, 0 if seq == 0 else 1, author, when, int(at.timestamp() * 1000), when[:10], subject, body)


@pytest.fixture(scope="module")
def study(spark):
    commits = [
        _commit(0, "2024-01-01T10:00:00Z", "Ann", "feat(cli): add parser"), _commit(1, "2024-01-01T12:00:00Z", "Ann", "feat(cli): add flags"),
        _commit(2, "2024-06-01T10:00:00Z", "Ann", "docs: describe usage"), _commit(3, "2024-06-01T11:00:00Z", "Bob", "docs: describe output")]
    changed = [(0, "src/cli/parse.py", "added", 100, 0), (1, "src/cli/flags.py", "added", 50, 0), (2, "README.md", "added", 20, 0), (3, "README.md", "modified", 10, 2)]
    texts = {"README.md": README, "docs/adr/0001-use-parquet.md": RECORD, "src/cli/parse.py": "x\n", "src/cli/flags.py": "y\n"}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Study(
        repos=table([(1, "tool", "main", "d" * 40, False)], "repo_id long, name string, branch string, head_sha string, is_shallow boolean"),
        commits=table(commits, "repo_id long, sha string, short_sha string, seq long, n_parents int, author_name string, authored_raw string, authored_ms long, authored_date string, subject string, body string"),
        changes=table([(1, "abcd"[s] * 40, s, 0, p, None, k, a, d) for s, p, k, a, d in changed],
                      "repo_id long, sha string, seq long, pos long, path string, previous_path string, status string, additions long, deletions long"),
        tags=table([(1, "v0.1.0", "b" * 40, 0)], "repo_id long, name string, sha string, pos long"),
        files=table([(1, p, len(t), f"o{p}", "file") for p, t in texts.items()], "repo_id long, path string, size long, object_id string, kind string"),
        blobs=table([(1, f"o{p}", t) for p, t in texts.items()], "repo_id long, object_id string, text string"),
        events=table([(1, 0, "talk.jsonl", 0, "line 1", "message", "user", "2024-01-01T09:00:00.000Z", "We decided to use plain files for storage.", None, None)],
                     "repo_id long, session_id long, file string, pos long, id string, kind string, role string, ts string, text string, command string, tool string"))


def test_milestones_and_members(study):
    rows = {r.id: r for r in study.milestones.collect()}
    assert sorted(rows) == ["M1", "M2"]
    assert (rows["M1"].title, rows["M1"].commits, rows["M1"].tag_count, rows["M1"].first_tag) == ("v0.1.0 · Feature work: cli", 2, 1, "v0.1.0")
    assert (rows["M2"].title, rows["M2"].additions, rows["M2"].deletions, rows["M2"].files_changed) == ("Documentation", 30, 2, 1)
    assert {(r.milestone, r.sha[0]) for r in study.members.collect()} == {(1, "a"), (1, "b"), (2, "c"), (2, "d")}
    assert (rows["M1"].drafts[0].level, rows["M1"].drafts[0].source.kind, rows["M1"].drafts[0].source["count"]) == ("inferred", "commit-range", 2)


def test_selected_commits(study):
    rows = study.selected_commits.collect()
    # four changes by people allow two commits: the best of each milestone
    # half of log2(1 + churn), one for a feature, one less for documentation, one for the tag: 4.33, 4.84, 1.20, 0.85
    assert [(r.sha[0], r.milestone) for r in sorted(rows, key=lambda r: r.sha)] == [("b", "M1"), ("c", "M2")]


def test_decisions_have_ids_by_section(study):
    rows = [(r.id, r.title, r.status, r.date) for r in study.decisions.orderBy("id").collect()]
    assert rows == [("D1", "Use Parquet files", "documented", "2024-01-02"), ("D2", "We decided to use plain files for storage.", "documented", "2024-01-01")]


def test_overview_names_commits_people_and_sessions(study):
    rows = {r.ord: r for r in study.with_evidence(study.overview, ["repo_id", "ord"]).collect()}
    assert rows[0].text == "The analyzed history contains 4 commits by 2 contributors, made between Jan 1, 2024 and Jun 1, 2024, a span of 153 days with commits on 2 days."
    assert rows[5].text == "1 development session (`talk.jsonl`) supplied 1 event of additional context."
    assert all(r.evidence for r in rows.values())


def test_every_statement_has_evidence_and_all_evidence_is_used(study):
    assert study.integrity.count() == 0
    first = study.evidence.filter("n = 1").first()
    assert (first.id, first.statement, first.level) == ("E1", "4 commits reachable from HEAD on `main`.", "observed")
    assert E.appendix(study.evidence).filter("id = 'E1'").first().source == "4 commits, `aaaaaaa` to `ddddddd`"
    numbers = sorted(r.n for r in study.evidence.collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_counts_and_findings(study):
    counts = {(r.what, r.value): r.n for r in evidence_counts(study).collect()}
    levels = [r.level for r in study.evidence.collect()]
    assert {v: n for (w, v), n in counts.items() if w == "evidence"} == {v: levels.count(v) for v in set(levels)}
    assert counts["decisions", "documented"] == 2
    found = study.findings.collect()
    assert {v: n for (w, v), n in counts.items() if w == "findings"} == {a: sum(r.area == a for r in found) for a in {r.area for r in found}}
    assert all(r.area_ord > 0 for r in found)


def test_case_study_holds_the_tables(study):
    row = study.case_study.select(F.to_json(F.struct("*")).alias("j")).collect()
    assert len(row) == 1
    got = json.loads(row[0].j)
    assert [m["id"] for m in got["timeline"]] == ["M1", "M2"]
    assert [d["id"] for d in got["decisions"]] == ["D1", "D2"]
    assert got["evidence_items"] == study.evidence.count()
    used = {e for part in ("overview", "technologies", "timeline", "decisions", "findings", "selected_commits") for r in got.get(part) or [] for e in r["evidence"]}
    assert used and used <= {r.id for r in study.evidence.collect()}


def test_generations_are_read_whole(study, spark, tmp_path):
    from repochron.operators.study import read_table

    folder = str(tmp_path / "tables")
    assert (study.write_tables(folder), study.write_tables(folder)) == (0, 1)
    for name in ("summaries", "milestones", "members", "decisions", "findings", "evidence", "limitations", "overview"):
        assert read_table(spark, folder, name).count() == getattr(study, name).count()


def test_planted_faults_are_found(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(6)], "repo_id long, ord long, name string")
    uses = E.explode_drafts(rows.withColumn("drafts", E.drafts(E.draft("observed", "x", F.col("name")))), "ord")
    numbered = E.number_evidence(uses)
    assert E.integrity(uses, numbered).count() == 0
    kept, used = numbered.filter("statement <> 't2'"), uses.filter("draft.statement <> 't4'")
    faults = E.integrity(used, kept).join(uses, ["repo_id", "key"]).select("draft.statement", "problem").collect()
    assert sorted(map(tuple, faults)) == [("t2", "unresolved"), ("t4", "unreferenced")]
