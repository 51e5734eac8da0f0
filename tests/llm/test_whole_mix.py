"""op9 places every occurrence in training, not only counts it."""

import pytest

from siltstone.llm.mixing import SLOPES, mix
from siltstone.llm.queries import QUERIES


def test_mix_places(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = sorted(tuple(r) for r in mix(docs).planned().select("id", "size", "copies", "taken").collect())
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    order = sorted({s for s in sources.values() if s is not None}) + [None]
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    assert sorted((r["doc_id"], r["size"], r["copies"], r["taken"]) for r in rows) == plan
    assert any(not r["copies"] for r in rows) and any(r["copies"] > 1 for r in rows)

    found = [x for r in rows for x in zip(r["mix_places"], r["mix_positions"], strict=True)]
    assert sorted(p for p, _ in found) == list(range(sum(r["copies"] for r in rows)))
    assert [t for _, t in sorted(found)] == sorted(t for _, t in found)

    checked = 0
    for r in rows:
        assert len(r["mix_positions"]) == r["copies"] and r["mix_places"] == sorted(r["mix_places"])
        slope = SLOPES[order.index(sources[r["doc_id"]]) % 3 + 1]
        given = [t * (1 + slope * (t - 1)) * r["target"] for t in r["mix_positions"]]
        for a, b in zip(given, given[1:], strict=False):
            if b < r["target"] * (1 - 1e-9):
                assert b - a == pytest.approx(r["source_size"], rel=1e-6)
                checked += slope != 0
    assert checked
