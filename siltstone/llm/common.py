"""Session helpers of this subpackage: shared scratch tables, slice-wise reductions, sorted groups, components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Counters or bits of one slice of a fixed-size sketch, in bytes.
SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the session's checkpoint folder; only local masters may have neither."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends in replicated files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def merge_slices(df: DataFrame, how: str, floats: int = 0) -> np.ndarray:
    """Sum or unite the slices ``(part long, slice int, data binary)`` of equally long arrays.

    ``or``: bits; ``sum``: float64 numbers; ``sparse``: uint32 counters sent by ``sparse_slices_of``; ``wide``: uint64
    counters sent by ``wide_slices_of``; ``mixed``: ``floats`` slices of float32 numbers, then wide ones, all returned as
    float64.  The result has a fixed size whatever the input; slices of at most 64 tasks meet at once on their way.
    """
    dtype = {"or": np.uint8, "sum": np.float64, "sparse": np.uint32, "wide": np.uint64, "mixed": np.float64}[how]
    packed = lambda at: how in ("sparse", "wide") or (how == "mixed" and at >= floats)

    def unpacked(data: bytes, at: int) -> np.ndarray:
        if how == "sparse":
            raw = zlib.decompress(data)
            return np.frombuffer(raw, dtype=np.uint8 if len(raw) == SLICE_BYTES // 4 else np.uint32).astype(np.uint32)
        if packed(at):
            return np.frombuffer(zlib.decompress(data), dtype=np.uint64)
        return np.frombuffer(data, dtype=np.float32 if how == "mixed" else dtype)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, at, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = unpacked(data, at)
                mine = held.get((part, at))
                if mine is None:
                    held[part, at] = got.copy()
                elif how == "or":
                    np.bitwise_or(mine, got, out=mine)
                else:
                    mine += got
        for (part, at), data in held.items():
            raw = zlib.compress(data.tobytes(), 1) if packed(at) else data.tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "slice": pa.array([at], pa.int32()), "data": pa.array([raw], pa.binary())})

    parts = df.rdd.getNumPartitions()
    while True:
        df = df.withColumn("part", F.floor(F.col("part") / 64)).repartition("part", "slice").mapInArrow(meet, "part long, slice int, data binary")
        if parts <= 64:
            break
        parts = -(-parts // 64)
    rows = sorted((r["slice"], bytes(r["data"])) for r in df.collect())
    return np.concatenate([unpacked(d, at).astype(dtype) for at, d in rows]) if rows else np.zeros(0, dtype=dtype)


def _batch(cut: list[bytes], part: int, first: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(cut), pa.int64()), "slice": pa.array(range(first, first + len(cut)), pa.int32()), "data": pa.array(cut, pa.binary())})


def slices_of(data: np.ndarray, part: int) -> pa.RecordBatch:
    raw = data.tobytes()
    return _batch([raw[k : k + SLICE_BYTES] for k in range(0, len(raw), SLICE_BYTES)], part)


def wide_slices_of(counters: np.ndarray, part: int, first: int = 0) -> pa.RecordBatch:
    """Compressed slices of uint64 counters, which no corpus fills; ``first`` is the number of the first slice."""
    raw = counters.astype(np.uint64).tobytes()
    return _batch([zlib.compress(raw[k : k + SLICE_BYTES], 1) for k in range(0, len(raw), SLICE_BYTES)], part, first)


def sparse_slices_of(counters: np.ndarray, part: int) -> pa.RecordBatch:
    """Slices of mostly small counters: saturated to a byte each and compressed.  Their number is a power of two."""
    raw, size = np.minimum(counters, 255).astype(np.uint8).tobytes(), SLICE_BYTES // 4
    return _batch([zlib.compress(raw[k : k + size], 1) for k in range(0, len(raw), size)], part)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by ``keys``: tables that hold whole groups only, with the groups' row offsets."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = last is None or last != tuple(c[0] for c in cols)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in cols)
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        if held or starts[-1] > 0:
            yield from _grouped([*held, batch.slice(0, int(starts[-1]))], keys)
        held = [batch.slice(int(starts[-1]))]
    if held:
        yield from _grouped(held, keys)


def _grouped(batches: list[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or batches[:1]).combine_chunks()
    if not table.num_rows:
        return
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    yield table, np.concatenate([np.flatnonzero(new), [table.num_rows]])


def lists_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list column without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    offsets = array.offsets.to_numpy().astype(np.int64)
    values = array.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def connected_components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a long, b long).

    Alternating large-star and small-star rounds; each is joins and partial minima on the edge table, which
    never grows, and is written to the shared folder.  Nodes without an edge to another node are absent.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    stamp = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stamp = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        star = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(least, "u")
        e = stage(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
