"""Dense and sparse vector retrieval, exact, as expressions; encoders are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def dense_topk(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """(``id_col``, similarity) of the k vectors with the largest cosine, ties by id; null vectors take no part."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.col(vector_col).isNotNull()).select(id_col, cosine(F.col(vector_col), q).alias("similarity"))
    return scored.orderBy(F.desc(F.round("similarity", 9)), id_col).limit(k)


def max_pool(weights: DataFrame, doc: str, token: str, weight: str) -> DataFrame:
    """(doc, token, w): the largest weight of a token over a document's parts."""
    return weights.groupBy(doc, token).agg(F.max(weight).alias("w"))


def sparse_search(pooled: DataFrame, query: dict[str, float], doc: str, token: str, k: int) -> DataFrame:
    """(doc, score) by the sparse inner product with the query's weights, best first, ties by doc."""
    terms = F.create_map(*(F.lit(x) for kv in query.items() for x in kv))
    hits = pooled.where(F.col(token).isin(list(query))).withColumn("part", F.col("w") * F.try_element_at(terms, F.col(token)))
    return hits.groupBy(doc).agg(F.sum("part").alias("score")).orderBy(F.desc(F.round("score", 9)), doc).limit(k)


def saturate(x: Column) -> Column:
    """log(1 + max(x, 0)), the activation of sparse encoders."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """L2-normalised mean of the token vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(token_vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1), lambda t: t["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), kept[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.nullif(norm(total), F.lit(0.0)))


def encode(df: DataFrame, text_col: str, build: Callable[[], Callable[[list[str]], list[list[float]]]], vector_col: str = "embedding") -> DataFrame:
    """``df`` with a vector from an injected encoder, built once in each worker and called on Arrow batches."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields if f.name != vector_col)}, `{vector_col}` array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for frame in frames:
            out = frame.drop(columns=[vector_col], errors="ignore")
            out[vector_col] = model([t or "" for t in frame[text_col]])
            yield out

    return df.mapInPandas(run, schema)


LISTS, CENTRE_SAMPLE = 64, 8192


def inverted_lists(vectors: DataFrame, id_col: str, vector_col: str, lists: int = LISTS, rounds: int = 8, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, ``vector_col``, list) with every vector in the list of its nearest centre, and the centres.

    Centres are fitted by spherical k-means on at most ``CENTRE_SAMPLE`` vectors, chosen by a hash; every vector is listed.
    """
    usable = vectors.where(F.col(vector_col).isNotNull() & (norm(F.col(vector_col)) > 0))
    drawn = usable.select(vector_col).orderBy(F.xxhash64(id_col, F.lit(seed))).limit(CENTRE_SAMPLE).toPandas()[vector_col]
    unit = np.array(drawn.tolist(), dtype=np.float64).reshape(len(drawn), -1)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    centres = unit[: min(lists, len(unit))].copy()
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1) if len(centres) else np.zeros(0, dtype=int)
        for c in range(len(centres)):
            if (near == c).any():
                centre = unit[near == c].mean(axis=0)
                centres[c] = centre / max(np.linalg.norm(centre), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame[vector_col].tolist(), dtype=np.float64)
                yield frame.assign(list=np.argmax(x @ shared.value.T, axis=1).astype(np.int32))

    return usable.select(id_col, vector_col).mapInPandas(run, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, list int"), centres


def listed_topk(listed: DataFrame, centres: np.ndarray, query: list[float], k: int, id_col: str, vector_col: str, probes: int = 16) -> DataFrame:
    """The k nearest by cosine among the vectors of the ``probes`` lists nearest to the query; stored by list, only these are read."""
    near = np.argsort(-(centres @ np.array(query)), kind="stable")[:probes].tolist()
    return dense_topk(listed.where(F.col("list").isin([int(x) for x in near])), query, k, id_col, vector_col)
