"""Bucketed numbering equals the plain window, also when one group holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from repochron.functions import paths
from repochron.operators import commits, highlights, ranking, study
from repochron.operators.path_dictionary import join_facts, path_facts


def _skewed(spark):
    rng = random.Random(1)
    rows, key = [], 0
    for repo, n in ((1, 3000), (2, 40), (3, 1)):
        for seq in range(n):
            key += rng.randint(1, 5)
            rows.append((repo, seq, rng.randint(0, 2), key * 7 % 1_000_003))
    return spark.createDataFrame(rows, "repo_id long, seq long, v long, key long").repartition(5)


def test_prefix_sum(spark):
    df = _skewed(spark)
    plain = df.withColumn("w", F.sum("v").over(Window.partitionBy("repo_id").orderBy("seq")))
    got = ranking.prefix_sum(df, ["repo_id"], "seq", F.col("v"), "w", rows=64)
    assert plain.select("repo_id", "seq", "w").exceptAll(got.select("repo_id", "seq", "w")).isEmpty()
    assert got.count() == df.count()


def test_number_rows_by_key(spark):
    df = _skewed(spark)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("key")).cast("long"))
    got = ranking.number_rows_by_key(df, ["repo_id"], "key", "n", buckets=16)
    assert plain.select("repo_id", "seq", "n").exceptAll(got.select("repo_id", "seq", "n")).isEmpty()


def test_first_rows_limits_before_the_shuffle(spark):
    df = _skewed(spark)
    plan = ranking.first_rows(df, ["repo_id"], [F.col("key")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_row_at_equals_a_sort(spark):
    rng = random.Random(9)
    rows = [(g, rng.randint(-10**15, 10**15) if g else i, n) for g, n in ((0, 700), (1, 501), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, k long, n long").withColumn("place", F.floor(F.col("n") / 2) + 1).repartition(5)
    got = {r.g: r.k for r in ranking.row_at(df, ["g"], "k", "place", buckets=8).collect()}
    assert got == {g: sorted(k for h, k, _ in rows if h == g)[n // 2] for g, n in ((0, 700), (1, 501), (2, 1))}


def test_scores_that_differ_in_the_ninth_digit_are_told_apart(spark):
    scores = [5.000000001, 5.000000002, 5.000000002, 5.0, -3.0, 13.0, 5.000000003]
    df = spark.createDataFrame([(1, i, s, 1) for i, s in enumerate(scores)], "repo_id long, seq long, score double, milestone long")
    ranked = {r.seq: r.rank for r in highlights.commit_score_rank(df).collect()}
    assert sorted(ranked, key=ranked.get) == [5, 6, 1, 2, 0, 3, 4]
    judged = highlights.with_median(df)
    assert {(r.median, r.eligible) for r in judged.collect()} == {(5.000000002, 7)}
    assert [r.seq for r in highlights.milestone_best_commit(judged).collect()] == [5]


def test_patterns_run_over_distinct_paths_only(spark):
    rows = [(1, f"s{i % 40}", "src/a.test.ts" if i % 3 else "package.json", "docs/old.md" if i % 5 == 0 else None, 2, 1) for i in range(300)]
    changes = spark.createDataFrame(rows, "repo_id long, sha string, path string, previous_path string, additions long, deletions long").repartition(3)
    facts = path_facts(changes, ["path", "previous_path"], {"test": paths.is_test_source, "doc": paths.is_documentation})
    assert {r.known_path: (r.test, r.doc) for r in facts.collect()} == {"src/a.test.ts": (True, False), "package.json": (False, False), "docs/old.md": (False, True)}
    joined = join_facts(join_facts(changes, facts, "path"), facts, "previous_path", "old_")
    assert joined.count() == 300 and {(r.path, r.test, r.old_doc) for r in joined.collect()} == {(p, p != "package.json", None if q is None else True) for _, _, p, q, _, _ in rows}
    plan = commits.change_facts(changes)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_readers_see_complete_generations_only(spark, tmp_path):
    folder = str(tmp_path)
    assert study.latest_generation(spark, folder) is None and study.next_generation(spark, folder) == 0
    write = lambda n, v: spark.createDataFrame([(1, v)], "repo_id long, v int").write.mode("overwrite").partitionBy("repo_id").parquet(f"{folder}/{n}/t")
    write(0, 5)
    study.list_generation(spark, folder, 0)
    write(study.next_generation(spark, folder), 6)  # not listed
    assert study.read_table(spark, folder, "t").first().v == 5 and study.next_generation(spark, folder) == 1
    write(1, 7)
    study.list_generation(spark, folder, 1)
    assert study.read_table(spark, folder, "t").first().v == 7
