"""All registered queries, by module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["link_queries", "text_queries", "mail_queries", "fusion_queries", "corpus_queries",
           "evaluation_queries", "operations_queries", "source_queries", "stream_queries"]


def _loaded():
    found = []
    for name in MODULES:
        try:
            found.append(importlib.import_module(f"inkwarden.plans.{name}"))
        except ModuleNotFoundError as error:
            if f"plans.{name}" not in str(error):
                raise
    return found


def queries() -> dict[str, Callable]:
    return {name: query for module in _loaded() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _loaded() for name, sql in module.ORACLES.items()}
