"""Few candidates: every query is answered with k rows, or with all other vectors."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.nearest import nearest


@pytest.mark.parametrize(("n", "seed"), [(15, 3), (21, 1)])
def test_no_short_answers(spark, n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 64))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.Counter(r["query_id"] for r in nearest(df, F.lit(True), k=20).collect())
    assert got == {k: min(20, n - 1) for k in range(n)}
