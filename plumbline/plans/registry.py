"""All registered queries with the SQL that states the same rows for an independent engine."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.bindings import PRELUDE, Tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules whose import registers queries.
MODULES = ("q_matrix", "q_rankings", "q_statistics", "q_resampling", "q_diagnostics", "q_forensics", "q_records", "q_domains", "q_sampling", "q_more")


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register ``f(tables)`` under ``name``; ``sql`` follows the bindings' WITH clause unless ``prelude`` is off."""

    def wrap(f: Callable[[Tables], DataFrame]):
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            text = sql.strip()
            _SQL[name] = text if not prelude else PRELUDE + (text[0:] if text.startswith(",") else text)
        return f

    return wrap


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"plumbline.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
