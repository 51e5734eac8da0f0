"""Each stage with nulls, repeated ids, empty and long texts, ties, extra columns with clashing names, and empty tables."""

import collections

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, mix_position double, shard_bytes long, c0 string"


def rows_of(sf, spark):
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 20)
    texts = [(1, "one two three four five six seven"), (1, "quite another text than that of the first row"), (None, "one two three four five six seven"), (None, None), (None, "a text without an id"),
             (2, ""), (2, ""), (3, "so " + item + " end"), (3, "clean though its id is that of a leak"), (None, "so " + item + " end"), (4, "long " * 30_000), (5, "tie"), (5, "tie")]
    return [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), k, "k", 9.0, 7, "x") for k, (i, t) in enumerate(texts)]


def keys(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_edges(spark, sf):
    rows = rows_of(sf, spark)
    docs = cp.materialize(spark.createDataFrame(rows, SCHEMA), "edges")
    every = keys(docs)
    assert keys(cp.drop_toxic(spark, docs, sf)) == every  # no label is for them, and none is like a toxic one

    near = cp.drop_near_duplicates(spark, docs, sf)
    gone = every - keys(near)
    assert near.columns == docs.columns and gone == collections.Counter({(None, "one two three four five six seven"): 1, (2, ""): 1, (None, rows[7][1]): 1, (5, "tie"): 1})

    leaks = cp.drop_contaminated(spark, docs, sf)
    assert leaks.columns == docs.columns and every - keys(leaks) == collections.Counter({(3, rows[7][1]): 1, (None, rows[7][1]): 1})

    mixed = cp.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and set(keys(mixed)) <= set(every) and {r["mix_position"] for r in mixed.collect()} == {9.0}

    shards = cp.cut_shards(spark, docs, sf).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in shards) == every


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_empty(spark, sf, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).collect() == []
