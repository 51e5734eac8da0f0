"""Token counts behind a digest cache.

A text's key is the SHA-256 of its normalised content (a null is the empty text; nothing else may be folded, since
the tokenizer itself normalises) together with the digest of the tokenizer's file.  Digests are joined with the stored
counts; of the rows whose digest is not stored, one for each digest is encoded, in place: a bit map of
bounded size, broadcast to the scan, marks the chosen rows, so texts are never shuffled.  New counts are
appended to the cache, a Parquet folder for each tokenizer version, and then all rows read theirs from it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import exists, materialize, merge_slices, scratch_path, slices_of

#: Bytes of text given to the tokenizer at once.
ENCODE_BYTES = 1 << 20
_WORKER: dict[str, object] = {}


def tokenizer_version(data: bytes, name: str) -> str:
    return hashlib.sha256(name.rpartition(".")[2].encode() + b"\0" + data).hexdigest()


def token_counter(data: bytes, name: str):
    """texts -> numbers of tokens, without begin, end or added special tokens, truncation or padding."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    model = tokenizers.Tokenizer.from_buffer(data)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def bit_map(slots: DataFrame, size: int) -> np.ndarray:
    """Bits of the ``slot`` values below ``size``, united over all tasks; ``size`` is a power of two."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size >> 3, dtype=np.uint8)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            np.bitwise_or.at(held, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        if held.any():
            yield slices_of(held, TaskContext.get().partitionId())

    found = merge_slices(slots.mapInArrow(mark, "part long, slice int, data binary"), "or")
    return found if len(found) else np.zeros(size >> 3, dtype=np.uint8)


def token_counts(df: DataFrame, model_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``model_path`` is a local file of the driver (.model: sentencepiece, .json: tokenizers); its bytes travel to the
    executors.  ``cache_path`` is a folder that all executors share; None takes a fresh one.  Null counts as the empty
    text.  Repeated rows and ids are counted row by row from one encoding.  Other columns are not read.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as f:
        data = f.read()
    name = model_path.rpartition("/")[2]
    version = tokenizer_version(data, name)
    folder = f"{cache_path or scratch_path(spark, 'token-cache')}/version={version}"
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keyed = materialize(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    wanted = keyed.groupBy("digest").agg(F.min("id").alias("id"))
    schema = "digest binary, n_tokens long"
    if exists(spark, folder):
        wanted = wanted.join(spark.read.schema(schema).parquet(folder), "digest", "left_anti")
    wanted = materialize(wanted, "misses")

    size = 1 << min(29, max(16, math.ceil(math.log2(16 * wanted.count() + 1))))
    slot = F.expr(f"pmod(xxhash64(id, digest), {size})").alias("slot")
    bits = spark.sparkContext.broadcast(bit_map(wanted.select(slot), size))
    model = spark.sparkContext.broadcast((version, name, data))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, name, data = model.value
        if version not in _WORKER:
            _WORKER[version] = token_counter(data, name)
        count, table = _WORKER[version], bits.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            numbers, some, held = [], [], 0
            for text in batch.column("text"):
                some.append(text.as_py())
                held += len(some[-1])
                if held >= ENCODE_BYTES:
                    numbers += count(some)
                    some, held = [], 0
            numbers += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(numbers, pa.int64())], names=["digest", "n_tokens"])

    fresh = rows.select("text", "digest", slot).mapInArrow(encode, schema)
    # A slot can be shared, so some rows were encoded beside the chosen ones; one count of each missing digest stays.
    fresh = fresh.dropDuplicates(["digest"]).join(wanted.select("digest"), "digest", "left_semi")
    fresh.write.mode("append").parquet(folder)
    # Runs at the same time can append a digest more than once; their counts are equal.
    stored = spark.read.schema(schema).parquet(folder).dropDuplicates(["digest"])
    return keyed.join(stored, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
