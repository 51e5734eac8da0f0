"""Names of queries and of their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.store import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the tables, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def joined(c: Column | str, by: str = ",") -> Column:
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), by)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def md5(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
