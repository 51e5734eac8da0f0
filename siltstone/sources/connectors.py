"""Readers of paged remote sources.  The transport is injected: a picklable function, so tests and offline runs need no network."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE_CAP, PAGE, BATCH, ATTEMPTS, WAIT_SECONDS, LEAST_CHARS, MENTIONS = 9999, 10_000, 200, 3, 5.0, 200, 200


def retried(call: Callable[[], object], attempts: int = ATTEMPTS, wait: Callable[[int], float] = lambda k: WAIT_SECONDS * k, sleep: Callable[[float], None] = time.sleep, refused: Callable[[object], str | None] = lambda _: None):
    """The result of ``call``; after a failure it waits ``wait(attempt)`` seconds and tries again, and the last failure is raised.

    ``refused`` tells an error that stands inside an answer: its message, or None.
    """
    for k in range(1, attempts + 1):
        try:
            got = call()
            if (problem := refused(got)) is not None:
                raise ValueError(f"the source answered with an error: {problem}")
            return got
        except Exception:
            if k == attempts:
                raise
            sleep(wait(k))


def offsets(fetch: Callable[[int, int], list | None], size: int) -> Iterator[object]:
    """Items of a source paged by offset; it ends with a page that is short, empty or None (not found)."""
    at = 0
    while True:
        page = retried(lambda: fetch(at, size)) or []
        yield from page
        if len(page) < size:
            return
        at += size


def paged_source(name: str, schema: str, total: Callable[[], int], fetch: Callable[[int, int], list[tuple]], size: int = PAGE) -> type[DataSource]:
    """A Python data source, to be registered, that reads ``total()`` rows in partitions of one page each."""

    class Page(InputPartition):
        def __init__(self, at: int) -> None:
            super().__init__(at)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Page(at) for at in range(0, retried(total), size)] or [Page(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from retried(lambda: fetch(partition.value, size)) or []

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Paged


def discover(spark: SparkSession, count: Callable[[dt.date, dt.date], int], fetch: Callable[[dt.date, dt.date, int, int], list[str]], first: dt.date, last: dt.date, cap: int = PAGE_CAP, page: int = PAGE, refused: Callable[[object], str | None] = lambda _: None) -> DataFrame:
    """(id) of all records between two dates; answers that ``refused`` gives a message for are asked again.

    A range with more than ``cap`` records is halved, the later half beginning a day after the middle; a single day over the
    cap is cut to it.  The driver asks for counts only; the pages of the windows are fetched by tasks.  A record that two
    windows give is there twice, and is made distinct where it is queued by key.
    """
    windows, waiting = [], [(first, last)]
    while waiting:
        a, b = waiting.pop()
        n = retried(lambda a=a, b=b: count(a, b), refused=refused)
        if n > cap and a < b:
            middle = a + (b - a) // 2
            waiting += [(middle + dt.timedelta(days=1), b), (a, middle)]
        elif n:
            windows += [(a, b, at, min(page, min(n, cap) - at)) for at in range(0, min(n, cap), page)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b, at, size in frame.itertuples(index=False):
                yield pd.DataFrame({"id": retried(lambda a=a, b=b, at=at, size=size: fetch(a, b, at, size), refused=refused)[:size]})

    if not windows:
        return spark.createDataFrame([], "id string")
    pages = spark.createDataFrame(windows, "a date, b date, at long, size long")
    return pages.repartition(max(1, min(len(windows), 256))).mapInPandas(run, "id string")


def fetch_batches(ids: DataFrame, id_col: str, fetch: Callable[[list], dict], size: int = BATCH) -> DataFrame:
    """(``id_col``, record, error) for every id: ``size`` ids a request; a failed request marks its own ids, an id that did not come back says so."""
    kind = ids.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            every = frame[id_col].tolist()
            for k in range(0, len(every), size):
                some = every[k : k + size]
                try:
                    got, error = retried(lambda some=some: fetch(some)), "not returned"
                except Exception as e:  # noqa: BLE001 - the error goes to the rows of the request
                    got, error = {}, str(e)[:2000]
                yield pd.DataFrame({id_col: some, "record": [got.get(i) for i in some], "error": [None if i in got else error for i in some]})

    return ids.select(id_col).mapInPandas(run, f"{id_col} {kind}, record string, error string")


def open_access(xml: Column) -> Column:
    """Whether a full-text answer holds an article at all."""
    return F.coalesce(F.contains(xml, F.lit("<article")), F.lit(False))


def siblings(labels: DataFrame, names: DataFrame, name: str, order: str, n: int = 10) -> DataFrame:
    """The ``n`` newest labels of each wanted name, case ignored."""
    wanted = names.select(F.lower(name).alias("_key")).distinct()
    found = labels.withColumn("_key", F.lower(name)).join(wanted, "_key")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc(order)))).where(F.col("place") <= n).drop("_key")


def relevant_articles(found: DataFrame, name: str, title: str, text: str, least: int = LEAST_CHARS) -> DataFrame:
    """Encyclopedia hits about the asked name: it stands in the title or in the first 500 characters, and the text is long enough."""
    about = F.contains(F.lower(title), F.lower(name)) | F.contains(F.lower(F.left(text, F.lit(500))), F.lower(name))
    return found.where(about & (F.length(text) >= least))


def mentions(docs: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str, words: list[str], most: int = MENTIONS) -> DataFrame:
    """(``name``, ``id_col``): up to ``most`` texts by id that hold a one-word name and any of ``words``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)"), F.lit(1)))
    held = docs.select(id_col, found.alias("_w")).where(F.arrays_overlap("_w", F.array(*(F.lit(w) for w in words))))
    hits = held.select(id_col, F.explode("_w").alias("_key")).join(names.select(name, F.lower(name).alias("_key")), "_key")
    return hits.withColumn("_place", F.row_number().over(Window.partitionBy(name).orderBy(id_col))).where(F.col("_place") <= most).select(name, id_col)
