"""Target-distribution importance resampling over partition-local word tries.

Features are the runs of 1 to ``most`` consecutive words.  A feature is a path in a trie of words; its node holds how
often it has occurred and the CRC-32 state of its bytes, so a longer feature's CRC goes on from its parent's.

1. Each task grows a trie over its texts and turns the nodes' counts into totals by bucket; a trie that has too
   many nodes is turned in early and begun anew, so a task's memory has a bound.  Totals are summed by slices.
2. Gains by bucket follow from the totals of the corpus and of the target texts.
3. Each task scores its texts by walking the paths of a trie whose nodes hold the gain of their bucket.

Draws are Gumbel top-k: of the documents with enough words the highest weight + noise are drawn, which is sampling
without repeats in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, merge_slices, wide_slices_of
from siltstone.llm.mixing import numbered

#: Nodes of a trie of one task, about 200 bytes each.
MOST_NODES = 1 << 20

#: Words are runs of 0-9, a-z and bytes of other characters than ASCII; A-Z is lower-cased, all else is blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Trie:
    """Nodes are lists [value, CRC-32 state, children or None]; a missing node is made on the way."""

    def __init__(self, start, most: int) -> None:
        """``start`` gives a new node's value from its CRC-32."""
        self.start, self.most, self.root, self.size = start, most, {}, 0

    def node(self, children: dict, word: bytes, crc: int | None) -> list:
        """The child for ``word`` of a node with the state ``crc`` (None: of the root)."""
        found = children.get(word)
        if found is None:
            state = zlib.crc32(word) if crc is None else zlib.crc32(word, zlib.crc32(b" ", crc))
            found = children[word] = [self.start(state), state, None]
            self.size += 1
        return found

    def paths(self, words: list[bytes]) -> Iterator[list]:
        """The nodes of all features of a text, repeats included."""
        most = self.most
        if most == 1:
            root, node = self.root, self.node
            for word in words:
                yield root.get(word) or node(root, word, None)
            return
        for at in range(len(words)):
            children, crc = self.root, None
            for word in words[at : at + most]:
                found = self.node(children, word, crc)
                yield found
                if found[2] is None:
                    found[2] = {}
                children, crc = found[2], found[1]

    def nodes(self) -> Iterator[list]:
        open_ = [self.root]
        while open_:
            for node in open_.pop().values():
                yield node
                if node[2]:
                    open_.append(node[2])


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))


def bucket_totals(df: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """How often features of ``df`` fall into each bucket; the result has ``buckets`` numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.uint64)
        trie = Trie(lambda state: 0, most)

        def turn_in() -> None:
            for value, state, _ in trie.nodes():
                totals[state % buckets] += np.uint64(value)
            trie.root, trie.size = {}, 0

        for batch in batches:
            for text in batch.column("text"):
                for node in trie.paths(words_of(text.as_py())):
                    node[0] += 1
                if trie.size > MOST_NODES:
                    turn_in()
        turn_in()
        yield wide_slices_of(totals, TaskContext.get().partitionId())

    found = merge_slices(_texts(df, text_col).mapInArrow(count, "part long, slice int, data binary"), "wide")
    return found if len(found) else np.zeros(buckets, dtype=np.uint64)


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln of a bucket's smoothed share of the target by its share of the corpus), by bucket."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(t) + 1) * (all_s + n) / ((int(s) + 1) * (all_t + n)))) for s, t in zip(corpus, target, strict=True)]


def weights(df: DataFrame, id_col: str, text_col: str, gain: list[int], most: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    spark, buckets = df.sparkSession, len(gain)
    given = spark.sparkContext.broadcast(gain)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = given.value
        trie = Trie(lambda state: gain[state % buckets], most)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                n_words.append(len(words))
                n_features.append(sum(max(len(words) - k, 0) for k in range(most)))
                weight.append(sum(node[0] for node in trie.paths(words)))
                if trie.size > MOST_NODES:
                    trie.root, trie.size = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """One row per input row: ``id_col``, n_features, weight, score, rank (from 1 for the drawn ones, else null).

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) with the highest scores are drawn; ties go
    to the smaller id, null last, then to fewer features; rows that are equal in all of these are told apart by
    no value of theirs, so the result is the same whichever comes first.  Rows that repeat an id have the same
    noise.  Null texts have no words; without words the weight is 0.  Texts are handled whole; a text's words are
    held while it is scored.  Empty tables, of documents or of target texts, give defined gains.  Other columns are not
    read.
    """
    gain = gains(bucket_totals(df, text_col, most, buckets), bucket_totals(target, target_col, most, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(df, id_col, text_col, gain, most).withColumn("score", F.col("weight") + noise)
    scored = materialize(scored, "weights")
    enough = F.col("n_words") >= least_words
    n_drawn = percent * scored.where(enough).count() // 100
    placed = numbered(scored.where(enough), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), name="place")
    placed = placed.withColumn("rank", F.when(F.col("place") < n_drawn, F.col("place") + 1))
    every = placed.drop("place").unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
