"""``@query`` collects the queries; each may carry the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # ``rnd(x, 6)`` is round with negative zero turned into zero.
            ORACLES[name] = sql.replace("rnd(", "0.0::DOUBLE + round(")
        return fn

    return register
