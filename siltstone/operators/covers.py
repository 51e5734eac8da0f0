"""Full-text rank by cover density over postings with positions and weight classes.

A *vector* of a document is the words of its fields with their positions, field after field; each field has a weight class.
A *cover* is a smallest run of positions that satisfies the query: for ``every`` it holds all terms and no shorter run inside
does, for ``any`` it is one hit.  A cover weighs the harmonic mean of its hits' weights, divided by one more than the words in
it that are no hits; a document's rank is the sum over its covers.

Hits come from postings kept by the term's bucket, so a search reads the buckets of its terms.  Covers are found in
the order of positions by windows over one sort: the cover that ends at a hit begins at the earliest of the
terms' last hits, and is a new one where that beginning moves.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.lexical import BUCKETS, STOP_WORDS, bucket_of, tokens

#: Weights of the classes.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def positions(docs: DataFrame, id_col: str, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """(term, doc, class, pos, bucket), clustered by bucket and sorted by term: as it is to be written.

    ``fields`` has a class and a text for each field, in order.  Positions count stop words, which are not posted; a field
    goes on counting from the last posted word of the one before.
    """
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    listed = docs.select(F.col(id_col).alias("doc"), *(tokens(text).alias(f"t{k}") for k, (_, text) in enumerate(fields.values())))
    # The last posted place of a field, from 1; 0 if it has none.
    last = lambda t: F.coalesce(F.array_max(F.transform(t, lambda w, i: F.when(~F.array_contains(stop, w), i + 1))), F.lit(0))
    starts = [F.lit(0)]
    for k in range(len(fields) - 1):
        starts.append(starts[-1] + last(F.col(f"t{k}")))
    every = F.array(*(F.struct(F.lit(c).alias("class"), start.alias("start"), F.col(f"t{k}").alias("words")) for k, ((c, _), start) in enumerate(zip(fields.values(), starts, strict=True))))
    rows = listed.select("doc", F.explode(every).alias("f")).select("doc", "f.class", "f.start", F.posexplode("f.words").alias("at", "term")).where(~F.col("term").isin(STOP_WORDS))
    rows = rows.select("term", "doc", "class", (F.col("start") + F.col("at") + 1).alias("pos"), bucket_of(F.col("term")).alias("bucket"))
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8)))
    return spread.sortWithinPartitions("bucket", "term", "doc", "pos")


def hits(post: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, term, pos, w) of the terms; only their buckets are read."""
    by_class = F.create_map(*(F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv))
    some = post.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(terms))
    return some.select("doc", "term", "pos", by_class[F.col("class")].alias("w"))


def covers(found: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, first, last, n, density): the covers by all ``terms``; n hits lie in each, and density is what it adds to the rank."""
    wanted = list(dict.fromkeys(terms))
    order = Window.partitionBy("doc").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    # Hits and weights are counted up to each position, so a cover's are differences.
    rows = found.withColumn("upto", F.struct("pos", F.count("*").over(before).alias("n"), F.sum(1 / F.col("w")).over(before).alias("inverse"), (1 / F.col("w")).alias("own")))
    lasts = [F.last(F.when(F.col("term") == t, F.col("upto")), ignorenulls=True).over(before) for t in wanted]
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in lasts))
    rows = rows.withColumn("begin", F.when(whole, F.least(*lasts) if len(lasts) > 1 else lasts[0]))
    rows = rows.withColumn("old", F.lag("begin").over(order)).where("begin is not null and (old is null or old.pos <> begin.pos)")
    n = F.col("upto.n") - F.col("begin.n") + 1
    inverse = F.col("upto.inverse") - F.col("begin.inverse") + F.col("begin.own")
    noise = F.col("pos") - F.col("begin.pos") - (n - 1)
    return rows.select("doc", F.col("begin.pos").alias("first"), F.col("pos").alias("last"), n.alias("n"), (n / inverse / (1 + noise)).alias("density"))


def cover_rank(post: DataFrame, terms: list[str], every: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, rank) of the documents that satisfy the query: all of ``terms``, or any of them."""
    found = hits(post, terms, weights)
    if every:
        return covers(found, terms).groupBy("doc").agg(F.sum("density").alias("rank"))
    return found.groupBy("doc").agg(F.sum("w").alias("rank"))


def best(ranked: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k best ranks, ties by document, without those below ``least``."""
    return ranked.where(F.round("rank", 9) >= least).orderBy(F.desc(F.round("rank", 9)), "doc").limit(k)
