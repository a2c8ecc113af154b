"""Query registry. A query is a function from the test tables to a DataFrame, with its oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from eoframe.sources.adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return register


def sql_text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def contains_sql(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, {sql_text(w)})" for w in words) + ")"
