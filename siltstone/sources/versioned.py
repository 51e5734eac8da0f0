"""Tables with versions: several of them change together or not at all, and of two writers one comes first.

A version is a manifest, a small JSON file that lists the Parquet files of each table by bucket.  A commit writes new files
for the buckets that it touches, carries the names of all others over, and puts the next manifest if it is absent.
Whoever loses that race looks at the winner's version and tries again, so a change is always made to
the version it is published after.  Readers see a whole version; what a broken writer left is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, ATTEMPTS = 16, 50


class Conflict(RuntimeError):
    """Other writers came first in every attempt."""


class Files:
    """What is needed of the store: reading and listing small files, and putting one if it is absent."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether this call put the file: it is written elsewhere and then gets its name in one step, whole.

        A rename does not replace a file where the store is a cluster's; a local one would, so there a link is made.
        """
        folder, _, leaf = name.rpartition("/")
        made = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(made), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.getScheme() != "file":
            done = not self.fs.exists(self.path(name)) and self.fs.rename(self.path(made), self.path(name))
        else:
            nio, local = self.jvm.java.nio.file, lambda p: self.jvm.java.nio.file.Paths.get(self.fs.makeQualified(self.path(p)).toUri())
            try:
                nio.Files.createLink(local(name), local(made))
                done = True
            except Exception:
                if not self.fs.exists(self.path(name)):
                    raise
                done = False
        self.fs.delete(self.path(made), False)
        return bool(done)


class Version:
    """One version: every table as it was."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict) -> None:
        self.spark, self.folder, self.manifest = spark, folder, manifest
        self.number: int = manifest["version"]

    def tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def files(self, table: str) -> dict[int, list[str]]:
        return {int(b): names for b, names in self.manifest["tables"][table]["files"].items()}

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """Buckets in which the keys of ``rows`` are."""
        entry = self.manifest["tables"][table]
        return sorted(r[0] for r in rows.select(_bucket(entry["key"], entry["buckets"]).alias("b")).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of ``table``, or those of some buckets: only their files are opened."""
        entry = self.manifest["tables"][table]
        schema = StructType.fromJson(entry["schema"])
        names = [f"{self.folder}/{n}" for b, ns in sorted(self.files(table).items()) if buckets is None or b in buckets for n in ns]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)


class VersionedTables:
    """The tables below ``folder``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Files(spark, self.folder)

    def last(self) -> int:
        return max((int(n[:-5]) for n in self.store.names(f"{self.folder}/log") if n.endswith(".json") and not n.startswith(".")), default=0)

    def at(self, number: int | None = None) -> Version:
        """A version by its number, or the last one; version 0 has no tables."""
        number = self.last() if number is None else number
        manifest = json.loads(self.store.read(self._log(number))) if number else {"version": 0, "tables": {}}
        return Version(self.spark, self.folder, manifest)

    def commit(self, change: Callable[[Version], dict[str, DataFrame]], keys: dict[str, list[str]] | None = None, buckets: int = BUCKETS, attempts: int = ATTEMPTS, append: tuple[str, ...] = ()) -> tuple[int, dict[str, DataFrame]]:
        """(version, changed rows by table): upserts of all tables that ``change`` names, in one version.

        Rows of the tables in ``append`` are added to their buckets, whose files stay as they are.

        ``change`` sees the version before and gives the new rows of each table, one a key; it is asked again if another
        writer came first.  ``keys`` has the key columns of tables that are new.  Without rows nothing is committed, and the
        version is the one that was seen.
        """
        for _ in range(attempts):
            before = self.at()
            mark = uuid.uuid4().hex
            try:
                tables, changed = self._written(before, change(before), keys or {}, buckets, f"data/{mark}", append)
            except BaseException:
                self.store.delete(f"{self.folder}/data/{mark}")
                raise
            if not tables:
                return before.number, changed
            manifest = {"version": before.number + 1, "tables": before.manifest["tables"] | tables}
            if self.store.put_if_absent(self._log(before.number + 1), json.dumps(manifest)):
                return before.number + 1, changed
            self.store.delete(f"{self.folder}/data/{mark}")
        raise Conflict(f"{attempts} attempts lost to other writers")

    def claim(self, table: str, status: str, queued: str, claimed: str, order: list[str], n: int, claimer: str, by: str = "claimed_by") -> DataFrame:
        """The n queued rows that come first, now ``claimed`` by ``claimer``; no two claims give one row."""

        def change(before: Version) -> dict[str, DataFrame]:
            rows = before.read(table)
            some = rows.where(F.col(status) == queued).orderBy(*order).limit(n)
            return {table: some.withColumn(status, F.lit(claimed)).withColumn(by, F.lit(claimer).cast(rows.schema[by].dataType))}

        return self.commit(change)[1][table]

    def compact(self, table: str, most: int = 8) -> int:
        """Buckets of more than ``most`` files get one file; the rows stay, and so does every other bucket."""
        for _ in range(ATTEMPTS):
            before = self.at()
            many = [b for b, names in before.files(table).items() if len(names) > most]
            if not many:
                return before.number
            entry, data = before.manifest["tables"][table], f"data/{uuid.uuid4().hex}"
            files = entry["files"] | self._stored(before.read(table, many), entry, f"{data}/{table}", many)
            manifest = {"version": before.number + 1, "tables": before.manifest["tables"] | {table: entry | {"files": files}}}
            if self.store.put_if_absent(self._log(before.number + 1), json.dumps(manifest)):
                return before.number + 1
            self.store.delete(f"{self.folder}/{data}")
        raise Conflict(f"{ATTEMPTS} attempts lost to other writers")

    def _stored(self, rows: DataFrame, entry: dict, where: str, buckets: list[int]) -> dict[str, list[str]]:
        """Files of ``rows`` by bucket, written below ``where``."""
        rows.withColumn("_bucket", _bucket(entry["key"], entry["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{where}")
        return {str(b): [f"{where}/_bucket={b}/{n}" for n in self.store.names(f"{self.folder}/{where}/_bucket={b}") if n.endswith(".parquet")] for b in buckets}

    def _log(self, number: int) -> str:
        return f"{self.folder}/log/{number:012d}.json"

    def _written(self, before: Version, changes: dict[str, DataFrame], keys: dict[str, list[str]], buckets: int, data: str, append: tuple[str, ...] = ()) -> tuple[dict, dict[str, DataFrame]]:
        """Manifest entries of the changed tables, whose files are written, and their changed rows."""
        tables, changed = {}, {}
        for table, rows in changes.items():
            entry = before.manifest["tables"].get(table) or {"schema": json.loads(rows.schema.json()), "key": keys[table], "buckets": buckets, "files": {}}
            schema = StructType.fromJson(entry["schema"])
            # Written first: the rows are asked for twice, and must be the same.
            rows.select(*schema.names).write.parquet(f"{self.folder}/{data}/{table}-rows")
            changed[table] = rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{data}/{table}-rows")
            bucket = _bucket(entry["key"], entry["buckets"])
            touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
            if not touched:
                continue
            if table in append:
                added = self._stored(rows, entry, f"{data}/{table}", touched)
                files = entry["files"] | {b: entry["files"].get(b, []) + names for b, names in added.items()}
            else:
                old = before.read(table, touched) if table in before.manifest["tables"] else self.spark.createDataFrame([], schema)
                merged = old.join(rows.select(*entry["key"]), entry["key"], "left_anti").select(*schema.names).unionByName(rows)
                files = entry["files"] | self._stored(merged, entry, f"{data}/{table}", touched)
            tables[table] = entry | {"files": files}
        return tables, changed


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*key), F.lit(buckets)).cast("int")
