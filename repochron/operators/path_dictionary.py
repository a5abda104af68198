"""Facts of paths, found once for every distinct path.

A history names the same paths again and again.  Pattern rules run over the distinct paths only;
rows get the facts by a join, which is a broadcast where the paths are few and a shuffled,
skew-splitting join where they are not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.session import stage


def path_facts(rows: DataFrame, columns: list[str], facts: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(known_path, facts...) of every distinct path in the ``columns``; written, so that its size is known."""
    named = reduce(DataFrame.union, [rows.select(F.col(c).alias("known_path")) for c in columns]).filter("known_path is not null").distinct()
    return stage(named.select("known_path", *[make("known_path").alias(name) for name, make in facts.items()]))


def join_facts(rows: DataFrame, facts: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``rows`` with the facts of a path column (null where the path is null), their names after ``prefix``."""
    names = [c for c in facts.columns if c != "known_path"]
    known = facts.select(F.col("known_path").alias(f"{prefix}known_path"), *[F.col(c).alias(f"{prefix}{c}") for c in names])
    return rows.join(known, F.col(column) == F.col(f"{prefix}known_path"), "left").drop(f"{prefix}known_path")
