"""Operators for training-data pipelines. Optional: nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES: list[str] = ["q_abuse", "q_entity_match", "q_history", "q_leaks", "q_mixing", "q_names", "q_nearest"]


def _loaded() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _loaded() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _loaded() for name, sql in m.SQL.items()}
