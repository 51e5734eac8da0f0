"""Signatures select the pairs whose shingles are compared exactly."""

from siltstone.llm import decontamination
from siltstone.llm.decontamination import candidates, contaminated


def test_signatures_select(spark):
    shingles = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (2, 90), (3, 90)], "doc long, h long")
    signatures = spark.createDataFrame([(10, 7, 2), (11, 7, 2), (90, 8, 1)], "h long, item long, least int")
    assert sorted(map(tuple, candidates(shingles, signatures).collect())) == [(1, 7), (2, 8), (3, 8)]


def test_few_pairs_are_compared(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    # Every document shares a run with the item; one contains it.
    docs = [(k, " ".join(words[k : k + 7]) + f" own{k}") for k in range(50)] + [(99, "so " + " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    found, real = [], decontamination.candidates

    def watched(*tables):
        found.extend(map(tuple, real(*tables).collect()))
        return real(*tables)

    monkeypatch.setattr(decontamination, "candidates", watched)
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in contaminated(df, items).collect()] == [(99, 5, 56)]
    assert (99, 5) in found and len(found) < 25  # all 51 share a run with the item
