"""Registered queries of the linking engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query under a name, with its SQL for DuckDB where SQL can say it."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLE[name] = oracle
        return function

    return add


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"lexilink.plans.{module}")


MODULES: tuple[str, ...] = ("homonym_plans", "retrieval_plans", "corpus_plans", "io_plans", "store_plans", "growth_plans")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
