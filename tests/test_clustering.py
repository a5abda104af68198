"""The verified shortening rounds give exactly what the sequential greedy run gives."""

import random

from pyspark.sql import functions as F

from repochron.operators import clustering

SCHEMA = ("repo_id long, unit long, n long, start long, end long, topics map<string,double>, kinds map<string,double>, "
          "weight double, mass double, churn long")
HOUR = 3_600_000


def _units(repo, count, seed, spread):
    rng = random.Random(seed)
    now, rows = 0, []
    churns = [rng.randint(0, 300) for _ in range(count)]
    for i in range(count):
        now += rng.choice(spread) * HOUR
        topics = {t: rng.random() + 0.1 for t in rng.sample(["cli", "core", "docs", "test", "ui"], rng.randint(0, 3))}
        weight = rng.choice([0.0] * 12 + [1.0, 0.5, 0.3])
        mass = 0.5 / count + 0.5 * churns[i] / max(1, sum(churns))
        rows.append((repo, i, 1, now, now + rng.randint(-5, 5) * HOUR, topics, {rng.choice(["feat", "fix"]): 1.0}, weight, mass, churns[i]))
    return rows


def _brute_force(rows, target, crumb_churn):
    """Scans all pairs for the cheapest one each time; rejected pairs stay out until a side changes."""
    groups = [dict(topics=dict(r[5]), kinds=dict(r[6]), start=r[3], end=r[4], weight=r[7], mass=r[8], n=r[2], churn=r[9], first_unit=r[1], last_unit=r[1]) for r in rows]
    rejected = set()
    while True:
        best = None
        for i in range(len(groups) - 1):
            pair = (id(groups[i]), groups[i]["n"], id(groups[i + 1]), groups[i + 1]["n"])
            if pair in rejected:
                continue
            cost = clustering._cost(groups[i], groups[i + 1], target)
            if best is None or cost < best[0]:
                best = (cost, i, pair)
        if best is None:
            return [(g["first_unit"], g["last_unit"]) for g in groups]
        _, i, pair = best
        left, right = groups[i], groups[i + 1]
        if len(groups) <= target and not clustering._voluntary(left, right, target, crumb_churn):
            rejected.add(pair)
            continue
        for field in ("topics", "kinds"):
            for k, v in right[field].items():
                left[field][k] = left[field].get(k, 0.0) + v
        left.update(start=min(left["start"], right["start"]), end=max(left["end"], right["end"]), weight=right["weight"], mass=left["mass"] + right["mass"],
                    n=left["n"] + right["n"], churn=left["churn"] + right["churn"], last_unit=right["last_unit"])
        del groups[i + 1]


def _ranges(df):
    return sorted((r.repo_id, r.milestone, r.first_unit, r.last_unit) for r in df.collect())


def test_one_task_run_equals_brute_force(spark):
    rows = _units(1, 150, 7, [1, 2, 30, 400])
    df = spark.createDataFrame(rows, SCHEMA)
    limits = clustering.repository_limits(df).first()
    expected = _brute_force(rows, limits.target, limits.crumb_churn)
    got = _ranges(clustering.cluster(df))
    assert [(a, b) for _, _, a, b in got] == expected
    assert len(got) <= 12


def test_verified_rounds_equal_the_sequential_run(spark):
    rows = _units(1, 900, 3, [1, 2, 5, 60]) + _units(2, 40, 4, [1, 50]) + _units(3, 700, 5, [1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    direct = _ranges(clustering.cluster(df, cell_units=10_000))
    celled = _ranges(clustering.cluster(df, cell_units=120))
    assert celled == direct
    for repo, last in ((1, 899), (2, 39), (3, 699)):
        own = [r for r in direct if r[0] == repo]
        assert own[0][2] == 0 and own[-1][3] == last
        assert all(a[3] + 1 == b[2] for a, b in zip(own, own[1:]))


def test_a_round_shortens_long_histories(spark):
    df = spark.createDataFrame(_units(1, 900, 3, [1, 2, 5, 60]), SCHEMA)
    limits = clustering.repository_limits(df)
    groups = clustering._frame(df)
    shortened, held = clustering._verified_round(groups, limits, 0.3, 120)
    assert held.count() == 1
    assert shortened.count() < 900
    assert shortened.agg(F.sum("n")).first()[0] == 900


def _equal_units(repo, count):
    return [(repo, i, 1, i * HOUR, i * HOUR, {"core": 1.0}, {"feat": 1.0}, 0.0, 1.0 / count, 10) for i in range(count)]


def test_one_stretch_of_equal_units_is_cut_and_revalidated(spark):
    """Pairs of equal cost merge from the left, so each cell's pairs depend on the parity left of it."""
    rows = _equal_units(1, 1500) + _equal_units(2, 333)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    direct = _ranges(clustering.cluster(df, cell_units=10_000))
    assert _ranges(clustering.cluster(df, cell_units=301)) == direct


def test_cells_stay_bounded_and_are_moved(spark, monkeypatch):
    rows = _equal_units(1, 1000)
    df = spark.createDataFrame(rows, SCHEMA)
    groups, limits = clustering._frame(df), clustering.repository_limits(df)
    moves, plain = [], clustering._moved
    monkeypatch.setattr(clustering, "_moved", lambda *a: (moves.append(a), plain(*a))[1])
    shortened, held = clustering._verified_round(groups, limits, 0.9, 101)
    expected = clustering.merge_groups([dict(r, topics={"core": 1.0}, kinds={"feat": 1.0}) for r in (x.asDict() for x in groups.orderBy("pos").collect())],
                                       12, 0.0, limit=_limit_of(groups, limits, 0.9))
    assert held.count() == 1 and len(moves) > 2
    assert sorted(r.first_unit for r in shortened.collect()) == [g["first_unit"] for g in expected]


def _limit_of(groups, limits, fraction):
    row = clustering._limits_at(clustering.pair_costs(groups.join(limits, "repo_id")), fraction).first()
    return row.cost_limit, row.pos_limit


def test_no_units_give_no_milestones(spark):
    assert _ranges(clustering.cluster(spark.createDataFrame([], SCHEMA))) == []
