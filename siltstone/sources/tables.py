"""Readers: Parquet tables, tolerant JSON records, date windows and seed dimensions."""

from __future__ import annotations

import bisect
import datetime as dt
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_tasks(rows: DataFrame, each: int = 1 << 19) -> int:
    """How many tasks take about ``each`` of the rows, one a core at least, so that what a task holds does not grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def dealt(rows: DataFrame, key: str, each: int = 1 << 19) -> DataFrame:
    """``rows`` dealt by a key to tasks of about ``each`` rows."""
    return rows.repartition(row_tasks(rows, each), key)


def dealt_as(rows: DataFrame, key: str, like: DataFrame, each: int = 1 << 19) -> DataFrame:
    """``rows`` dealt by a key to as many tasks as the rows of ``like`` need, and not fewer than other shuffles have."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, row_tasks(like, each)), key)


def text_tasks(rows: DataFrame, each: int = 32 << 20) -> int:
    """How many tasks take about ``each`` bytes of the rows' strings, one a core at least."""
    texts = [F.sum(F.octet_length(f.name)) for f in rows.schema.fields if f.dataType.typeName() == "string"]
    least = rows.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-sum(n or 0 for n in rows.agg(*texts).first()) // each)) if texts else least


def parsed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that costs much to make, a parsed text, made once a row whatever is asked of its fields.

    Conditions on fields would go below a plain column and parse each row again, as often as they name one; below a
    generated column none goes.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def pending(work: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``work`` without the next stage's output (NOT EXISTS)."""
    return work.join(done.select(*([key] if isinstance(key, str) else key)), key, "left_anti")


def split_windows(daily: DataFrame, cap: int) -> list[tuple[dt.date, dt.date, int, bool]]:
    """(from, to, rows, truncated): a date range halved until each window has at most ``cap`` rows; empty windows go.

    A single day over the cap cannot be halved: of it ``cap`` rows can be had, and the window is marked.  ``daily`` is (day
    date, n long).  Counts of windows are differences of running sums over a list with an entry a day, a size that the
    calendar bounds.
    """
    rows = sorted((r["day"], r["n"]) for r in daily.groupBy("day").agg(F.sum("n").alias("n")).collect())
    days, sums = [d for d, _ in rows], [0, *itertools.accumulate(n for _, n in rows)]
    out, waiting = [], [(days[0], days[-1])] if rows else []
    while waiting:
        a, b = waiting.pop()
        n = sums[bisect.bisect_right(days, b)] - sums[bisect.bisect_left(days, a)]
        if n > cap and a < b:
            middle = a + (b - a) // 2
            waiting += [(middle + dt.timedelta(days=1), b), (a, middle)]
        elif n:
            out.append((a, b, min(n, cap), n > cap))
    return out


def first_text(*columns: Column) -> Column:
    """First non-blank of alternative string or string-array columns; of an array its first element."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def first_element(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def activity_filter(df: DataFrame, value: str, confidence: str, least: float, most: float) -> DataFrame:
    """Rows of enough confidence whose value is at most ``most`` or unknown."""
    return df.where((F.col(confidence) >= least) & (F.col(value).isNull() | (F.col(value) <= most)))
