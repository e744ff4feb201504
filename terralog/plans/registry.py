"""The list of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terralog.plans.views import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def sql(body: str, *views: str) -> str:
    """``body`` with the named view definitions in front."""
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in views]
    text = body.strip()
    if parts and text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + text[15:]
    if parts and text.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + text[5:]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + text


def query(covers: str, oracle: str | None = None):
    """Register a function of ``Tables`` under its own name; ``covers`` lists the operator ids."""
    def add(run: Callable[[Tables], DataFrame]):
        if run.__name__ in _QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        _QUERIES[run.__name__] = Query(run.__name__, tuple(covers.split()), run, oracle)
        return run

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(item: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: item.run(Tables(spark, sf_dir))

    return {name: bind(item) for name, item in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: item.oracle for name, item in _QUERIES.items() if item.oracle}
