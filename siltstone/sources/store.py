"""Artefacts kept between queries: an index, an edge table.  They lie in the shared folder as Parquet.

An artefact is addressed by a digest of the files that it may have been made of, so a table that is written anew has others.
Builders write to a folder of their own and then put a pointer if there is none: of two at a time one wins, and a
builder that stops leaves no pointer.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import read_table
from siltstone.sources.versioned import Files


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the session's checkpoint folder; only local masters may have neither."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    given = given or tempfile.mkdtemp(prefix="siltstone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Tables:
    """The tables of a folder by name, and what has been derived from them once in this application."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def stamp(self) -> str:
        """A digest of the names, lengths and times of the folder's files."""
        files = Files(self.spark, self.folder)
        found, waiting = [], [(files.path(self.folder), 2)]
        while waiting:
            where, depth = waiting.pop()
            for status in files.fs.listStatus(where):
                found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
                if status.isDirectory() and depth > 1:
                    waiting.append((status.getPath(), depth - 1))
        return hashlib.sha256("\n".join([self.folder, *sorted(found)]).encode()).hexdigest()[:24]

    def kept(self, name: str, build: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
        """The artefact ``name`` of this folder as it is now: written by the first query that asks for it, read by later ones.

        It belongs to the application, as another one may build it in another way.
        """
        files = Files(self.spark, shared_folder(self.spark))
        base = f"{shared_folder(self.spark)}/siltstone/{self.spark.sparkContext.applicationId}/{self.stamp()}"
        pointer = f"{base}/{name}.pointer"
        if not exists(self.spark, pointer):
            own = f"{base}/{name}-{uuid.uuid4().hex}"
            writer = build().write
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(own)
            if not files.put_if_absent(pointer, own):
                files.delete(own)
        return self.spark.read.parquet(files.read(pointer))
