"""Graph upkeep as a stream: provenance of co-occurrences is appended batch by batch, each batch once.

A batch's provenance rows, its sources and its number are committed in one version, so a batch that is delivered again
finds its number and changes nothing, and sources that come again under another number are known.  Provenance is only
appended, by bucket of the source; buckets of many files are compacted now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.sources.versioned import Version, VersionedTables

KEYS = {"provenance": ["source"], "batches": ["stream", "batch"]}
COMPACT_EVERY = 16


def upkeep(tables: VersionedTables, group: str, member: str, stream: str = "members", compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over (group, member); a group comes whole in one batch."""

    def apply(members: DataFrame, batch: int) -> None:
        spark = members.sparkSession

        def change(before: Version) -> dict[str, DataFrame]:
            done = before.read("batches").where((F.col("stream") == stream) & (F.col("batch") == batch)) if "batches" in before.tables() else None
            if done is not None and not done.isEmpty():
                return {}
            fresh = members.select(F.col(group).alias("source"), F.col(member).alias("_member"))
            if "provenance" in before.tables():
                # Only the buckets of the batch's own sources are looked at.
                known = before.read("provenance", before.touched("provenance", fresh.select("source"))).select("source").distinct()
                fresh = fresh.join(known, "source", "left_anti")
            rows = graph.entity_rows(fresh, "source", "_member")
            return {"provenance": rows, "batches": spark.createDataFrame([(stream, batch)], "stream string, batch long")}

        tables.commit(change, KEYS, append=("provenance",))
        if batch % compact_every == compact_every - 1:
            tables.compact("provenance")

    return apply


def edges(tables: VersionedTables, least: int = 1) -> DataFrame:
    """(a, b, weight) of the last version."""
    return graph.weighted(tables.at().read("provenance"), least)
