"""Registry of the contract queries: a name, a function of (spark, sf_dir), and SQL where it can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` reads the views fx_<view>."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Rounded to six decimals, so that the order of a sum does not show; never a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + 0.0
