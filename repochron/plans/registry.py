"""Collects the named queries and, where SQL can express them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repochron.plans.corpus import Corpus
from repochron.plans.oracle_corpus import with_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Registers ``build(corpus) -> DataFrame`` under ``key``."""

    def register(build: Callable[[Corpus], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: build(Corpus(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_corpus(oracle, extra)
        return build

    return register
