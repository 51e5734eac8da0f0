"""The permutation index at growing sizes: recall against brute force, and the share of pairs that is scored at all."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import nearest as index


def clustered(n, seed, d=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(8, n // 100), d))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, d))).astype(np.float32)


def recalls(spark, x, asked, k=20):
    """Recall of each query, and what the operator says of the sampled ones."""
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, ord string")
    got, said = collections.defaultdict(set), {}
    for r in index.nearest(df, F.col("vec_id") % asked == 0, k=k).collect():
        got[r["query_id"]].add(r["vec_id"])
        if r["recall"] is not None:
            said[r["query_id"]] = r["recall"]
    true, wide = {}, x.astype(np.float64)
    for q in range(0, len(x), asked):
        s = wide @ wide[q]
        s[q] = -np.inf
        true[q] = len(set(np.argsort(-s)[:k].tolist()) & got[q]) / k
    assert said and all(abs(true[q] - r) < 0.051 for q, r in said.items())
    return np.array(list(true.values()))


def unlike(n, seed):
    """Candidates in clusters, queries in any direction."""
    x = clustered(n, seed)
    x[::20] = np.random.default_rng(seed + 1).standard_normal(x[::20].shape)
    return x


def lengths(n, seed):
    return (clustered(n, seed) * np.random.default_rng(seed + 1).lognormal(0, 1, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("made", [clustered, unlike, lengths])
def test_few_queries_miss_more_than_a_tenth(spark, made):
    found = recalls(spark, made(8000, 3), 20)
    print(made.__name__, found.mean(), (found < 0.9).mean(), found.min())
    assert found.mean() >= 0.95 and (found < 0.9).mean() <= 0.05


@pytest.mark.parametrize(("n", "most"), [(900, 0.7), (10_000, 0.3)])
def test_recall_and_work(spark, monkeypatch, n, most):
    work = []
    real = index.calibrated
    monkeypatch.setattr(index, "calibrated", lambda *a: work.append(real(*a)) or work[-1])
    found = recalls(spark, clustered(n, 3), 50)
    print(n, work, found.mean())
    assert found.mean() >= 0.95 and all(w[3] < most for w in work)


def test_a_band_that_misses_too_much_is_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(index, "calibrated", lambda *a: (1, 500, 0.0, 0.0))
    assert recalls(spark, clustered(900, 4), 30).min() == 1.0


def test_one_hot_pivot(spark, monkeypatch):
    """Files longer than a block are cut, and the answers stay the same."""
    x = clustered(600, 5, 8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, index.nearest(df, F.col("vec_id") % 10 == 0, k=5).select("query_id", "rank", "vec_id").collect()))
    monkeypatch.setattr(index, "BLOCK", 16)
    monkeypatch.setattr(index, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, index.nearest(df, F.col("vec_id") % 10 == 0, k=5).select("query_id", "rank", "vec_id").collect())) == whole
