"""The pipeline's stages on the smallest tables, against brute force where a stage decides by a rule."""

import collections

import corpus_pipeline as cp
from tests.llm.test_pairs import sets_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in cp.STAGES:
        after = cp.materialize(stage(spark, before, sf), "test")
        if name != cp.STAGES[-1][0]:
            assert after.columns == columns
        if name == "near duplicates":
            check_near(before.collect(), {r["doc_id"] for r in after.collect()})
        if name in ("toxicity", "near duplicates", "decontamination"):
            assert after.count() == after.select("doc_id").distinct().count() <= before.count()
        before = after
    sizes = collections.Counter()
    for r in before.collect():
        sizes[r["shard_id"]] += r["row_bytes"]
    assert sizes and max(sizes.values()) <= cp.SHARD_BYTES


def check_near(rows, kept):
    sets = {r["doc_id"]: sets_of(r["text"], 5) for r in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if root(i) == i}
