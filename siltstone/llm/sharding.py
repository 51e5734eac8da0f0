"""Sharding by extendible hashing.

Rows are keyed by a hash; the directory is indexed by leading bits of it.  It starts with about as many buckets as
the total bytes need; a bucket over the byte limit, and only such a bucket, splits on its next bit, until every
bucket fits.  Sums by prefix are aggregated before they meet: one round settles several bits, and only rows
of buckets still too large enter the next.  The leaves stay a distributed table.

The first 40 bits come from id and text, the others from the row's position in the scan: even a row repeated
without end splits on.  A single row over the limit cannot be split and is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize

#: Bits that one round can settle beyond those that the mean fill needs; deepest prefix.
STEP, DEEPEST = 5, 63
#: Leaves are broadcast to the rows up to this number (about 30 MB), and joined by a shuffle beyond it.
BROADCAST_LEAVES = 1_000_000


def _prefix(key: str, depth: str | int) -> Column:
    return F.expr(f"if({depth} = 0, 0L, shiftrightunsigned({key}, 64 - {depth}))")


def shard(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` (columns ``keep``, by default all) with shard_id, shard_depth, shard_bytes and row_bytes.

    row_bytes is the UTF-8 length of the text (null: 0); shard_id is the shard's hash prefix as a bit string
    (empty for the only shard); shard_bytes is the sum of row_bytes of its rows, at most ``limit_bytes`` unless the shard
    is a single row.  Null ids hash like any value.  An empty table gives no rows.  Columns of ``df`` that are named
    like a new one are replaced.
    """
    keep = [c for c in (keep or df.columns) if c not in ("shard_id", "shard_depth", "shard_bytes", "row_bytes")]
    key = F.expr("(shiftleft(shiftrightunsigned(h1, 24), 24) | shiftrightunsigned(h2, 40))")
    rows = df.select(
        *(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"),) if keep else (F.struct(F.lit(0)).alias("kept"),),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("row_bytes"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h1"),
        F.xxhash64(F.monotonically_increasing_id()).alias("h2"),
    )
    rows = rows.select("kept", "row_bytes", key.alias("key"))
    rows = materialize(rows, "keyed")  # a row's position must not change once a leaf depends on it
    slim = rows.select("key", "row_bytes")

    total = slim.agg(F.coalesce(F.sum("row_bytes"), F.lit(0))).first()[0]
    low = max(0, math.floor(math.log2(max(total, 1) / limit_bytes)) - 1) if total > limit_bytes else 0
    leaves, first = None, low
    while True:
        high = min(DEEPEST, low + STEP)
        fine = slim.groupBy(_prefix("key", high).alias("fine")).agg(F.sum("row_bytes").alias("bytes"), F.count("*").alias("rows"))
        fine = materialize(fine, "prefixes")
        levels = fine.withColumn("depth", F.explode(F.expr(f"sequence({low}, {high})")))
        levels = levels.withColumn("prefix", F.expr(f"if({high} = depth, fine, shiftrightunsigned(fine, {high} - depth))"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = fits.where((F.col("bytes") <= limit_bytes) | (F.col("rows") == 1) | (F.lit(high) == DEEPEST) & (F.col("depth") == DEEPEST))
        settled = levels.select("fine", "depth", "prefix").join(fits, ["depth", "prefix"])
        settled = settled.groupBy("fine").agg(F.min_by(F.struct("depth", "prefix", "bytes"), "depth").alias("leaf"))
        found = settled.select("leaf.*").distinct().select("depth", "prefix", "bytes")
        leaves = materialize(found if leaves is None else leaves.unionByName(found), "leaves")
        if high == DEEPEST:
            break
        open_ = materialize(fine.join(settled.select("fine"), "fine", "left_anti").select("fine"), "open")
        if open_.isEmpty():
            break
        slim = materialize(slim.withColumn("fine", _prefix("key", high)).join(open_, "fine").drop("fine"), "slim")
        low = high + 1

    # A key lies in exactly one leaf: its prefixes of the leaves' depths meet the directory.
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())
    if not depths:
        depths = [first]
    number = leaves.count()
    leaves = leaves.withColumnRenamed("bytes", "shard_bytes")
    if number <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    # The directory entry of a key is looked up for every depth in use; there are few.
    probes = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix("key", d).alias("prefix")) for d in depths))
    found = rows.withColumn("probe", F.explode(probes)) if len(depths) > 1 else rows.withColumn("probe", probes[0])
    found = found.select("kept", "row_bytes", "probe.*").join(leaves, ["depth", "prefix"])
    name = F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")
    return found.select(*(["kept.*"] if keep else []), name.alias("shard_id"), F.col("depth").cast("int").alias("shard_depth"), "shard_bytes", "row_bytes")
