"""Inverted lists against the exact scan, and the connectors' failures."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import druglabels, ingestion, keys, vectors
from siltstone.sources import connectors


def test_lists_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    listed, centres = vectors.inverted_lists(rows, "vec_id", "embedding")
    assert listed.count() == rows.count() and listed.select("list").distinct().count() > 30
    query = [((k * 7) % 5 - 2) / 2 for k in range(64)]
    exact = {r["vec_id"] for r in vectors.dense_topk(rows, query, 20, "vec_id", "embedding").collect()}
    near = {r["vec_id"] for r in vectors.listed_topk(listed, centres, query, 20, "vec_id", "embedding", probes=48).collect()}
    every = {r["vec_id"] for r in vectors.listed_topk(listed, centres, query, 20, "vec_id", "embedding", probes=64).collect()}
    assert every == exact and len(near & exact) >= 16


def test_retries_and_offsets():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert connectors.retried(flaky, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(OSError):
        connectors.retried(lambda: (_ for _ in ()).throw(OSError("gone")), attempts=2, sleep=waits.append)
    pages = {0: [1, 2], 2: [3, 4], 4: None}
    assert list(connectors.offsets(lambda at, size: pages[at], 2)) == [1, 2, 3, 4]
    assert list(connectors.offsets(lambda at, size: [1], 2)) == [1]


def test_failed_requests_mark_their_own_ids(spark):
    def fetch(ids):
        if 4 in ids:
            raise ValueError("x" * 3000)
        return {i: str(i) for i in ids if i != 1}

    ids = spark.createDataFrame([(k,) for k in range(6)], "id long").coalesce(1)
    got = {r["id"]: (r["record"], r["error"]) for r in connectors.fetch_batches(ids, "id", fetch, 2).collect()}
    assert got[0] == ("0", None) and got[1] == (None, "not returned") and got[3] == ("3", None) and got[4][0] is None and len(got[5][1]) == 2000


def test_entities_and_outcomes_of_empty_tables(spark):
    chunks = spark.createDataFrame([(1, "TP53 gene", [("GENE", 0, 4, 0.9), ("GENE", 0, 4, None), ("GENE", 4, 4, 0.9), ("GENE", 5, 9, 0.4), ("MASS", 0, 9, 1.0)])], "c long, t string, s array<struct<label:string,start:int,end:int,score:double>>")
    assert [tuple(r) for r in ingestion.entities(chunks, "c", "t", "s").collect()] == [(1, "TP53", "GENE_OR_GENE_PRODUCT", 0, 4)]
    none = spark.createDataFrame([], "k long")
    assert ingestion.batch_outcomes(none, none, none, "k").collect() == []


def test_keys_without_parents_and_labels_without_dates(spark):
    table = spark.createDataFrame([(1, "a", None, True, False), (2, "b", 1, False, False), (3, "c", 2, False, True), (4, "", 1, False, False)], "id long, key string, parent_id long, is_admin boolean, is_revoked boolean")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 9), (6, None)], "request int, parent_id long")
    made = {r["request"]: r["granted"] for r in keys.mint(asked, table).collect()}
    assert made == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert keys.looked_up(spark.createDataFrame([("",), ("c",), ("b",)], "key string"), table).where("id is not null").count() == 1
    labels = spark.createDataFrame([("A", 1, None), ("a", 2, 5), ("B", 3, None), (None, 4, 9)], "n string, k int, u long")
    got = druglabels.newest_labels(labels.where("false"), labels, "n", "u").select("n", "k").collect()
    assert sorted(map(tuple, got)) == [("B", 3), ("a", 2)]


def test_iso_dates(spark):
    texts = ["2021-01-05", "2021-Jan-05", "2021", "2021-02-30", "2021 Jan-Feb", "20210105", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(ingestion.iso_date(F.col("t")).cast("string").alias("a"), ingestion.iso_date(F.col("t"), compat=True).cast("string").alias("b")).collect()
    assert [r["a"] for r in rows] == ["2021-01-05", "2021-01-05", None, None, None, None, None] and [r["b"] for r in rows][1] is None
