"""Tables of the study are built at the same time, and its wide steps do their work once."""

import math
import random
import threading

from pyspark.sql import functions as F

from repochron.functions import text as T
from repochron.operators import clustering, milestones, practice, ranking, technology
from repochron.session import once, side_by_side
from test_study import study  # noqa: F401


def test_tables_are_built_at_the_same_time_and_once(spark):
    both, built = threading.Barrier(2, timeout=20), []

    class Tables:
        @once
        def shared(self):
            built.append(1)
            return len(built)

        @once
        def one(self):
            both.wait()
            return self.shared

        @once
        def other(self):
            both.wait()
            return self.shared

    tables = Tables()
    assert side_by_side(spark, lambda: tables.one, lambda: tables.other) == [1, 1]
    assert built == [1] and Tables().shared == 2


def test_a_named_table_gets_the_ids_that_its_frame_gets(study):  # noqa: F811
    rows = lambda table: sorted((r.ord, r.text, r.evidence) for r in study.with_evidence(table, ["repo_id", "ord"]).collect())
    assert rows("overview") == rows(study.overview) and rows("overview")


def test_keys_are_compared_with_one_stretch_of_the_limits(spark):
    rng = random.Random(5)
    rows = [(g, k) for g, n in ((1, 900), (2, 3), (3, 40)) for k in rng.sample(range(10**6), n)]
    df = spark.createDataFrame(rows, "g long, k long")
    limits = ranking._key_limits(df, ["g"], "k", 256)
    assert max(len(s) for r in limits.collect() for s in r._limits) <= 16
    numbered = {(r.g, r.k): r.n for r in ranking.number_rows_by_key(df, ["g"], "k", "n").collect()}
    assert numbered == {(g, k): i + 1 for g in (1, 2, 3) for i, k in enumerate(sorted(k for h, k in rows if h == g))}
    slots = df.join(limits, "g").select("g", "k", ranking._slot("k").alias("s"), F.size(F.filter(F.flatten("_limits"), lambda x: x < F.col("k"))).alias("all"))
    assert slots.filter("s <> all").isEmpty()


def test_sentences_are_cut_only_where_a_rationale_can_be(spark):
    texts = ["Kept in memory because disk is slow.", "Files in order\n   to commit them. Nothing here.", "Kept so\r\nthat users see it.", "Short because.", "because `a.b because` x",
             "- one\n- instead\n\nof the other thing here", "we\tchose the plain form of it", "TRADE-OFFS were weighed here at length", "becausexx it does not count as one", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select(T.rationale_sentences("t").alias("found"), F.coalesce(F.filter(T.sentences("t"), T.has_rationale), F.array().cast("array<string>")).alias("plain")).collect()
    assert [r.found for r in row] == [r.plain for r in row] and sum(bool(r.found) for r in row) >= 4


def test_areas_are_found_for_paths_not_for_changes(spark):
    rows = [(1, 1, "src/cli/a.ts", 3, 1, True), (1, 1, "src/cli/a.ts", 2, None, False), (1, 1, "src/cli/a.ts", 2, None, True), (1, 1, None, 1, 1, True), (1, 2, "docs/x.md", 5, 5, True)]
    changed = spark.createDataFrame(rows, "repo_id long, milestone long, path string, additions long, deletions long, described boolean")
    churn = milestones.path_churn(changed)
    assert {(r.path, r.described): r.churn for r in churn.filter("milestone = 1").collect()} == {("src/cli/a.ts", True): 8, ("src/cli/a.ts", False): 3, (None, True): 3}
    assert sorted(map(str, milestones.top_areas(churn).collect())) == sorted(map(str, milestones.top_areas(changed).collect()))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_first_test_file_and_marker_names_take_no_shuffle_of_changes_or_commits(spark):
    people = spark.createDataFrame([(1, 0, "a", "a", "2024", False, False), (1, 1, "b", "b", "2024", False, True), (2, 0, "c", "c", "2024", False, True)],
                                   "repo_id long, seq long, sha string, short_sha string, authored_date string, is_merge boolean, test_commit boolean")
    changes = spark.createDataFrame([(1, "b", 1, 5, "src/a.ts", None, "added"), (1, "b", 1, 7, "test/b.test.ts", None, "added"), (1, "b", 1, 6, "test/c.test.ts", None, "added"),
                                     (2, "c", 0, 0, "README.md", None, "added"), (2, "c", 0, 1, "bun.lock", None, "added")],
                                    "repo_id long, sha string, seq long, pos long, path string, previous_path string, status string")
    found = practice.test_touching_commits(people, changes)
    assert {(r.repo_id, r.first_path, r.ordinal) for r in found.collect()} == {(1, "test/c.test.ts", 2), (2, None, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in x and "RLIKE" in x and "path#" in x for x in plan.splitlines())
    history = technology.marker_history(people.select("repo_id", "sha", "short_sha", "authored_date"), changes, changes.select("repo_id", "path"))
    assert {(r.repo_id, r.tool, r.added_short, r.removed_short) for r in history.collect()} == {(2, "Bun", "c", None)}
    assert _shuffles(history) == 0


def test_merges_do_not_depend_on_how_shares_are_summed():
    a, b = {"x": 0.1, "y": 0.2, "z": 0.3}, {"y": 0.7, "z": 0.1, "w": 1e-17}
    pairs = [(a.get(k, 0.0), b.get(k, 0.0)) for k in {**a, **b}]
    assert clustering._share_similarity(a, b) == math.fsum(map(min, pairs)) / math.fsum(map(max, pairs))
    assert clustering._share_similarity(a, {"v": 1.0}) == 0.0 and clustering._share_similarity(None, a) == 0.0
