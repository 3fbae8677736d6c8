"""Query registry: name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle."""

    def put(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _ORACLE[name] = sql
        return fn

    return put


def _load() -> None:
    from dealframe.plans import analysis_queries, analytics_queries, augment_queries, bidding_queries, bridge_queries, core_queries, learning_queries, results_queries, search_queries, service_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
