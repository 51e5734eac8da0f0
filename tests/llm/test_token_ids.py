"""Tokens of two sets are never taken for the same."""

from pyspark.sql import functions as F

from siltstone.llm import jaccard_join as j


def test_ids_do_not_collide(spark):
    tokens = spark.range(400_000)
    assert tokens.select(F.shiftright(F.xxhash64("id"), 32)).distinct().count() < 400_000  # 32 bits do
    assert tokens.select(j._ids(F.col("id"))).distinct().count() == 400_000
