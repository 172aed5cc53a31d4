"""The table of registered queries: name -> (callable, SQL twin or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_TABLE: dict[str, tuple[Query, str | None]] = {}
_MODULES = (
    "graph_plans", "match_plans", "rewrite_plans", "eventlog_plans", "process_plans", "adaptive_plans",
    "effect_plans", "trust_plans", "claim_plans", "bootstrap_plans", "source_plans", "admission_plans",
    "stream_plans",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _TABLE:
            raise ValueError(f"query {name!r} is registered twice")
        _TABLE[name] = (fn, sql)
        return fn

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"hyperlake.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return {name: fn for name, (fn, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _TABLE.items() if sql is not None}
