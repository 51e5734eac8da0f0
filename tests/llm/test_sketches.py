"""Sketches of documents: fewer probes than shingles, and no item of the exact answer is lost, with and without broadcasts."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination
from siltstone.llm.decontamination import contaminated, shares, sketches


def corpus(seed):
    """Items of 5 to 300 words; documents that hold them whole, with words left out, scattered, or in part."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(r.choice([5, 8, 13, 40, 120, 300])))) for k in range(30)]
    docs = []
    for k in range(150):
        words = [word() for _ in range(r.randrange(600))]
        for _ in range(r.randrange(3)):
            item = r.choice(items)[1].split()
            for _ in range(r.randrange(1 + len(item) // 12)):
                item[r.randrange(len(item))] = "changed"
            cut = r.randrange(len(words) + 1)
            half = len(item) // 2 if r.random() < 0.3 else len(item)
            words[cut:cut] = item[:half] + ["between"] * (half < len(item)) + item[half:]
        docs.append((k, " ".join(words)))
    return docs, items


def exact(docs, items):
    def runs(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    held = {k: runs(t) for k, t in docs}
    wanted = {k: runs(t) for k, t in items}
    return sorted((d, i, len(s), len(s & h)) for d, h in held.items() for i, s in wanted.items() if len(s & h) >= 0.8 * len(s) - 1e-9)


@pytest.mark.parametrize("seed,broadcast", [(1, True), (2, True), (3, False)])
def test_no_item_is_lost(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
        monkeypatch.setattr(decontamination, "BROADCAST_PAIRS", 0)
    docs, items = corpus(seed)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = exact(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in got) == want and len(want) > 30


def test_a_sketch_is_smaller_than_the_shingles(spark):
    docs, _ = corpus(4)
    df = spark.createDataFrame(docs, "doc long, text string")
    every = sketches(df, {5: (1 << 63) - 1}).count()
    signatures = spark.createDataFrame([(-(1 << 62), 5), (-(1 << 63), 5), (7, 2)], "h long, width int")
    most = shares(signatures)
    assert most == {5: -(1 << 62), 2: 7}
    part = sketches(df, {5: most[5]})
    assert 0.2 * every < part.count() < 0.3 * every and part.where(F.col("h") > most[5]).count() == 0
