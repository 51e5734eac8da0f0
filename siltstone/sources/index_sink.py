"""A bulk sink for index documents: a Python data source whose tasks write parts and whose commit makes them visible.

A task writes its rows as one Parquet part and answers with the part's name; the commit puts one file that names the parts of
all tasks.  What no commit names is not in the index, so a failed write leaves it as it was.  Of rows with one key the one
of the last commit counts, and of one commit the one of the largest ``version``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from siltstone.sources.versioned import Files


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """Rows of a task, batch by batch, into a part of its own; a retried task writes another one."""
        fs, base = self._store()
        name, rows, writer = f"parts/{self.run}/{uuid.uuid4().hex}.parquet", 0, None
        fs.create_dir(f"{base}/parts/{self.run}", recursive=True)
        for batch in iterator:
            writer = writer or pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=fs)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Part("", 0)
        writer.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, base = self._store()
        names = [m.name for m in messages if m and m.rows]
        fs.create_dir(f"{base}/commits", recursive=True)
        mark = f"{time.time_ns():020d}-{self.run}"
        with fs.open_output_stream(f"{base}/commits/.{mark}") as out:
            out.write(json.dumps({"parts": names, "rows": sum(m.rows for m in messages if m)}).encode())
        fs.move(f"{base}/commits/.{mark}", f"{base}/commits/{mark}.json")

    def abort(self, messages: list[Part | None]) -> None:
        fs, base = self._store()
        if fs.get_file_info(f"{base}/parts/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/parts/{self.run}")


class IndexSink(DataSource):
    """``df.write.format("siltstone_index").mode("append").save(path)`` after ``spark.dataSource.register(IndexSink)``."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_index"

    def writer(self, schema: StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["path"])


def commits(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(mark, parts) of each commit, oldest first."""
    files = Files(spark, path)
    return [(n, json.loads(files.read(f"{path}/commits/{n}"))["parts"]) for n in files.names(f"{path}/commits") if n.endswith(".json") and not n.startswith(".")]


def read_index(spark: SparkSession, path: str, schema: StructType | str, key: str, version: str) -> DataFrame:
    """The documents of the index, one a key."""
    rows = None
    for place, (_, parts) in enumerate(commits(spark, path)):
        if parts:
            some = spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in parts)).withColumn("_commit", F.lit(place))
            rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return spark.createDataFrame([], schema)
    last = Window.partitionBy(key).orderBy(F.desc("_commit"), F.desc(version))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", "_commit")


def bulk_write(rows: DataFrame, path: str) -> None:
    """``rows`` into the index at ``path`` (a URI that all executors share), all or none."""
    rows.sparkSession.dataSource.register(IndexSink)
    rows.write.format(IndexSink.name()).mode("append").option("path", path).save()
