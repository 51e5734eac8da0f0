"""Jaccard join, decontamination and nearest neighbours against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.common import connected_components
from siltstone.llm.decontamination import contaminated
from siltstone.llm.jaccard_join import jaccard_join
from siltstone.llm.nearest import nearest


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, num, den):
    sets, parent = [sets_of(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = [0] * len(rows), [1] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                copies[a] += sets[a] == sets[b]
                copies[b] += sets[a] == sets[b]
                parent[root(a)] = root(b)
    comp = collections.defaultdict(list)
    for a in range(len(rows)):
        comp[root(a)].append(rows[a][0])
    return sorted((rows[a][0], len(sets[a]), copies[a], links[a], min(comp[root(a)])) for a in range(len(rows)))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    out = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 30, 60, 150]))]
        for _ in range(rng.choice([1, 2, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return list(enumerate(out + ["", "  ", None, "one", "One", "one two", "long " * 3000]))


@pytest.mark.parametrize("width,num,den,block", [(3, 90, 100, 1500), (5, 80, 100, 5)])
def test_jaccard_join(spark, width, num, den, block):
    rows = texts(width)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, digest int")
    got = jaccard_join(df, width=width, threshold=(num, den), block_sets=block).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "n_copies", "n_links", "component_id")) for r in got) == brute(rows, width, num, den)


def test_jaccard_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = jaccard_join(rows).collect()
    assert sorted((str(r["doc_id"]), r["n_copies"], r["component_id"]) for r in got) == [("1", 3, 1), ("1", 3, 1), ("2", 1, 2), ("None", 3, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 7), (7, 5), (9, 9), (5, 130)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {5} and len(got) == 33


def test_contaminated(spark):
    rng = random.Random(3)
    word = lambda: f"t{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 12, 30, 33, 64, 120])] + [(90, ""), (91, None), (92, "  ")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(200)]
        _, text = items[k % 10]
        part = text.split()
        part = part[int(len(part) * rng.choice([0, 0, 0.1, 0.3])) :]
        docs.append((k, " ".join([*body[:100], *part, *body[100:]]).upper() if k % 2 else " ".join([*part, *body])))
    docs += [(900, None), (901, ""), (902, "t1")]
    got = contaminated(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in got.collect())
    want = []
    for i, t in items:
        n = len((t or "").split())
        width = min(5, n)
        own = sets_of((t or "").lower(), width) if n else frozenset()
        for d, text in docs:
            w = (text or "").lower().split()
            have = {tuple(x.encode() for x in w[k : k + width]) for k in range(len(w) - width + 1)} if width else set()
            both = len(own & have)
            if own and both >= 0.8 * len(own) - 1e-9:
                want.append((d, i, len(own), both))
    assert got == sorted(want) and len(want) > 30


def test_contaminated_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "f g h"), (None, "a b c d e")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).collect() == []
    twice = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e")], "item_id long, text string")
    assert [tuple(r) for r in contaminated(docs, twice).collect()] == [(1, 4, 1, 1, 1.0)]
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), twice).collect() == []


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2.0, (n, 1))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of the rows are one vector
    return x.astype(np.float32).astype(float)


def test_nearest(spark):
    x = vectors(900, 16, 5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0], 0), (None, x[3].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, same int")
    got = collections.defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["rank"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [k for k in np.lexsort((np.arange(900), -np.round(s, 12))) if k != q][:20]
        assert [r for _, r, _ in found] == list(range(1, 21)) and q not in [v for v, *_ in found]
        assert all(abs(s[v] - score) < 1e-9 for v, _, score in found)
        hits += len(set(order) & {v for v, *_ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_edges(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = nearest(few, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 0.0)]
