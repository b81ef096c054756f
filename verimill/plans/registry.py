"""All registered queries of the library's operators, with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def now() -> Column:
    """The moment that queries take for now."""
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


View = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the views as a query; `sql` is its checking SQL, with views in braces."""

    def add(f: Callable[[View], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(partial(view, spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


from . import q_basic, q_change, q_knowledge, q_more, q_search  # noqa: E402, F401
