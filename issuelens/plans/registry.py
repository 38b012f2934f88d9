"""Registry of named queries (one per operator id of the survey) and their oracles.

A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is DuckDB SQL
over the same parquet tables (registered as views named like the tables).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "issuelens.plans.q_retrieval",
    "issuelens.plans.q_profile",
    "issuelens.plans.q_text",
    "issuelens.plans.q_landing",
    "issuelens.plans.q_evaluation",
    "issuelens.plans.q_stream",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
