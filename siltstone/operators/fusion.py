"""Rank fusion and the retrieval cascade: pools, reciprocal ranks, adaptive target, first chunks, graph boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import lexical, vectors

RRF_K, DYNAMIC_RATIO, LEAST_RESULTS, CHUNKS_EACH, GRAPH_WEIGHT = 60, 0.10, 5, 3, 0.3


def pool_size(top_k: int) -> int:
    return max(5 * top_k, 100)


def ranked(scores: DataFrame, doc: str, score: str, name: str) -> DataFrame:
    """(doc, ``name``): 1-based rank by score, ties by doc.  ``scores`` is a pool already cut to its size."""
    return scores.select(F.col(doc).alias("doc"), F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), doc)).alias(name))


def last_rank(ranks: DataFrame, parent: str, rank: str, compat: bool = False) -> DataFrame:
    """A parent's best rank over its rows; with ``compat`` its worst."""
    return ranks.groupBy(parent).agg((F.max(rank) if compat else F.min(rank)).alias(rank))


def rrf(*ranks: Column) -> Column:
    """Sum of 1 / (60 + rank) over the rankings that have the document."""
    return sum((F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def fuse(a: DataFrame, b: DataFrame, rank_a: str, rank_b: str) -> DataFrame:
    """(doc, rank_a, rank_b, rrf) over the union of two rankings."""
    return a.join(b, "doc", "full").withColumn("rrf", rrf(F.col(rank_a), F.col(rank_b)))


def target(pool: Column, top_k: int, ratio: float = DYNAMIC_RATIO, least: int = LEAST_RESULTS, compat: bool = False) -> Column:
    """A tenth of the pool, at least ``least`` and at most ``top_k``; with ``compat`` the floor beats ``top_k``."""
    share = F.floor(pool * ratio).cast("int")
    floored = F.greatest(F.lit(least), F.least(F.lit(top_k), share))
    return floored if compat else F.least(floored, F.lit(top_k))


def adaptive(fused: DataFrame, top_k: int, widen: int = 1, compat: bool = False) -> DataFrame:
    """The best ``widen`` times target documents with place and target; the pool is two rankings of bounded size."""
    every = Window.partitionBy()
    placed = fused.withColumn("pool", F.count("*").over(every)).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("rrf", 9)), "doc")))
    return placed.withColumn("target", target(F.col("pool"), top_k, compat=compat)).where(F.col("place") <= widen * F.col("target"))


def retrieved(found: lexical.Index, terms: list[str], embedded: DataFrame, query: list[float] | None, id_col: str, vector_col: str, top_k: int = 20, allowed: DataFrame | None = None, widen: int = 1, least_share: float = 0.5, compat: bool = False) -> DataFrame:
    """The fused pool of a question, cut to ``widen`` times its target: (doc, ranks, rrf, pool, place, target).

    Half of the terms must match on the lexical side, which alone obeys ``allowed``; without a query vector it is the only one.
    """
    pool = pool_size(top_k)
    bm25 = ranked(lexical.search(found, terms, pool, least_share=least_share, allowed=allowed), "doc", "score", "bm25_rank")
    if query is None:
        return adaptive(bm25.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("rrf", rrf(F.col("bm25_rank"))), top_k, widen, compat)
    dense = ranked(vectors.dense_topk(embedded, query, pool, id_col, vector_col), id_col, "similarity", "dense_rank")
    return adaptive(fuse(bm25, dense, "bm25_rank", "dense_rank"), top_k, widen, compat)


def first_chunks(chunks: DataFrame, doc: str, order: str, n: int = CHUNKS_EACH) -> DataFrame:
    """The first n chunks of each document by position."""
    return chunks.withColumn("chunk_place", F.row_number().over(Window.partitionBy(doc).orderBy(order))).where(F.col("chunk_place") <= n)


def normalised(score: Column) -> Column:
    """Share of the best possible fused score (first in both rankings), at most 1, four digits."""
    return F.round(F.least(score / (2.0 / (RRF_K + 1)), F.lit(1.0)), 4)


def boosted(kept: DataFrame, boosts: DataFrame, weight: float = GRAPH_WEIGHT) -> DataFrame:
    """(…, combined, final_place) after adding ``weight`` times a document's graph boost (doc, boost), cut to the target."""
    joined = kept.join(boosts, "doc", "left").withColumn("combined", F.col("rrf") + weight * F.coalesce("boost", F.lit(0.0)))
    placed = joined.withColumn("final_place", F.row_number().over(Window.orderBy(F.desc(F.round("combined", 9)), "place")))
    return placed.where(F.col("final_place") <= F.col("target"))


def reranked(kept: DataFrame, chunks: DataFrame, boosts: DataFrame, weight: float = GRAPH_WEIGHT) -> DataFrame:
    """``kept`` (doc, place, target, rrf) by score plus ``weight`` times the largest boost of a document's chunks, cut to the target.

    ``chunks`` is (doc, chunk), ``boosts`` (chunk, boost).  ``kept`` should hold more than the target, so that the graph has
    something to lift.
    """
    best = chunks.join(boosts, "chunk").groupBy("doc").agg(F.max("boost").alias("boost"))
    return boosted(kept, best, weight)


def page(found: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of an ordered result, with ``total``: only the rows up to the page's end are numbered."""
    total = found.agg(F.count("*").alias("total"))
    head = found.orderBy(*order).limit(offset + limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return head.where(F.col("position") > offset).crossJoin(F.broadcast(total))


def shown_order(found: DataFrame, relevance: str, place: str) -> DataFrame:
    """``found`` (at most a result page) with ``shown``: by the rounded score, equal scores in the order they had.

    Scores are those before the graph's boost, so the graph decides which documents are shown and the order of equal ones.
    """
    return found.withColumn("shown", F.row_number().over(Window.orderBy(F.desc(relevance), place)))
