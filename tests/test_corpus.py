"""Building the derived tables: what is sorted and shuffled, and keys that come twice."""

import datetime

import pytest

from repochron.plans.corpus import Corpus
from repochron.session import stage

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


def corpus(spark, folder, orders, lines):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 3, "a"), (2, 4, "b")], "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, c, day) for k, c in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return Corpus(spark, str(folder))


def line(order, part, number, flag="N"):
    return (order, part, 1, number, 5.0, 1.0, 0.02, flag, "O")


def test_first_line_of_a_path_is_kept(spark, tmp_path):
    # part 4 is README.md, 12 a manifest; order 7 comes twice, its lines are numbered together
    lines = [line(1, 4, 2, "A"), line(1, 22, 3), line(1, 12, 1), line(7, 4, 1), line(7, 12, 2), line(7, 22, 3), line(None, 4, 1), line(99, 4, 1)]
    c = corpus(spark, tmp_path, [(1, 1), (7, 2), (7, 2), (None, 1)], lines)
    rows = {(r.repo_id, r.pos, r.path, r.status, r.additions, r.deletions) for r in c.changes().collect()}
    assert rows == {(3, 1, "Cargo.toml", "modified", 5, 2), (3, 2, "README.md", "added", 5, 2), (4, 1, "README.md", "modified", 5, 2), (4, 3, "crates/globset/Cargo.toml", "modified", 5, 2)}
    assert {(r.repo_id, r.path, r["size"]) for r in c.files().collect()} == {(3, "Cargo.toml", 97), (3, "README.md", 97), (4, "README.md", 97), (4, "crates/globset/Cargo.toml", 97)}


def test_rows_are_narrow_where_they_are_sorted(spark, tmp_path):
    c = corpus(spark, tmp_path, [(1, 1)], [line(1, 4, 1)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # files are counted by hashing, and no hash of a commit goes through a shuffle
    assert "SortAggregate" not in plan(c._build_files())
    shuffles = [x for x in plan(c._build_changes()).splitlines() if "Exchange" in x]
    assert shuffles and not any("sha#" in x for x in shuffles)
    assert not any("sha#" in x for x in plan(c._build_changes()).split("\n") if "FileScan" in x and "stage-" in x)


def test_staged_tables_are_entropy_coded(spark):
    path = stage(spark.range(10)).inputFiles()[0]
    assert path.endswith(".zstd.parquet")


@pytest.mark.parametrize("flag, status", [("A", "added"), ("N", "modified"), ("R", "renamed"), (None, "renamed")])
def test_status(spark, tmp_path, flag, status):
    c = corpus(spark, tmp_path, [(1, 1)], [line(1, 4, 1, flag)])
    assert [(r.status, r.previous_path) for r in c.changes().collect()] == [(status, "old/README.md" if status == "renamed" else None)]
