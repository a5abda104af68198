"""Steps of the study go through few shuffles and few rounds, with the results of the plain form."""

from pyspark.sql import functions as F

from repochron.operators import clustering, highlights
from repochron.operators import commits as K
from test_clustering import SCHEMA, _units


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_people_are_kept_without_a_shuffle_of_the_commits(spark):
    rows = [(1, "a", False), (1, "b", True), (2, "c", True), (2, "c", True), (None, "d", False)]
    people = K.people(spark.createDataFrame(rows, "repo_id long, sha string, automated boolean"))
    assert _exchanges(people) == 0
    assert sorted((r.repo_id, r.sha) for r in people.collect()) == [(1, "a"), (2, "c"), (2, "c")]


def test_topics_take_one_shuffle(spark):
    summaries = spark.createDataFrame([(1, "a", "cli"), (1, "b", None), (1, "c", "core")], "repo_id long, sha string, scope string")
    changes = spark.createDataFrame(
        [(1, "a", "src/cli/x.ts", 2, 0), (1, "a", "docs/x.md", None, None), (1, "b", "README.md", 5, 5), (1, "b", None, 10, 0)],
        "repo_id long, sha string, path string, additions long, deletions long")
    topics = K.commit_topics(summaries, changes)
    assert _exchanges(topics) == 1
    assert {(r.sha, r.topic): r.weight for r in topics.collect()} == {
        ("a", "cli"): 1.75, ("a", "docs"): 0.25, ("b", "docs"): 0.5, ("b", None): 0.5, ("c", "core"): 1.0}


def test_pair_costs_take_one_shuffle_and_go_over_block_borders(spark, monkeypatch):
    features = spark.createDataFrame(_units(1, 60, 3, [1, 2, 5, 60]) + _units(2, 1, 4, [1]) + _units(3, 16, 5, [9]), SCHEMA)
    groups = clustering._frame(features).join(F.broadcast(clustering.repository_limits(features)), "repo_id").localCheckpoint()
    costs = lambda: {(r.repo_id, r.pos): r.cost for r in clustering.pair_costs(groups).collect()}
    assert _exchanges(clustering.pair_costs(groups)) == 1
    whole = costs()
    monkeypatch.setattr(clustering, "PAIR_ROWS", 8)
    assert costs() == whole
    assert sorted(whole) == [(1, i) for i in range(59)] + [(3, i) for i in range(15)]


def test_long_histories_take_few_rounds(spark, monkeypatch):
    df = spark.createDataFrame(_units(1, 3000, 3, [1, 2, 5, 60]), SCHEMA).repartition(4).cache()
    rounds, plain = [], clustering._verified_round
    monkeypatch.setattr(clustering, "_verified_round", lambda *a: (rounds.append(a), plain(*a))[1])
    clustering.cluster(df, cell_units=300)
    assert len(rounds) <= 3


def test_the_median_is_joined_without_a_shuffle_of_the_commits(spark):
    scored = spark.createDataFrame([(1, float(i), i) for i in range(9)] + [(2, 3.5, 0)], "repo_id long, score double, seq long")
    judged = highlights.with_median(scored)
    assert _exchanges(judged) == 0
    assert {(r.repo_id, r.eligible, r.median) for r in judged.collect()} == {(1, 9, 4.0), (2, 1, 3.5)}
