"""Derived corpus and the registered queries."""

from __future__ import annotations

import importlib

MODULES = ["classify_queries", "fact_queries", "milestone_queries", "text_queries", "study_queries"]


def load_queries():
    """(queries, oracles) of every query module."""
    for module in MODULES:
        importlib.import_module(f"repochron.plans.{module}")
    from repochron.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
