"""Covers against a sweep over each document, positions over fields, ranks of any term, edges."""

import random

from pyspark.sql import functions as F

from siltstone.operators import covers
from siltstone.operators.lexical import STOP_WORDS

TERMS = ["red", "plate", "brass"]


def vector(fields):
    """[(word, class, position)] of [(class, text)]."""
    out, start = [], 0
    for c, text in fields:
        words = (text or "").split()
        out += [(w, c, start + k + 1) for k, w in enumerate(words) if w not in STOP_WORDS]
        start += max((k + 1 for k, w in enumerate(words) if w not in STOP_WORDS), default=0)
    return out


def sweep(words, terms):
    """From each start on: the first end by which all terms have come, then the last beginning that still holds them."""
    found = [(p, w, covers.WEIGHTS[c]) for w, c, p in words if w in terms]
    out, at = [], 0
    while True:
        seen, end = set(), None
        for k in range(at, len(found)):
            seen.add(found[k][1])
            if len(seen) == len(set(terms)):
                end = k
                break
        if end is None:
            return out
        seen, begin = set(), end
        while True:
            seen.add(found[begin][1])
            if len(seen) == len(set(terms)):
                break
            begin -= 1
        inside = found[begin : end + 1]
        noise = (inside[-1][0] - inside[0][0]) - (len(inside) - 1)
        out.append((inside[0][0], inside[-1][0], len(inside), round(len(inside) / sum(1 / w for _, _, w in inside) / (1 + noise), 9)))
        at = begin + 1


def rows():
    r = random.Random(3)
    some = ["red", "plate", "brass", "the", "of", "steel", "x"]
    text = lambda n: " ".join(r.choice(some) for _ in range(n))
    made = [(k, text(r.randrange(6)), text(r.randrange(25)), text(r.randrange(10))) for k in range(120)]
    return [*made, (200, None, None, None), (201, "", "the of", "red"), (202, "the", "red plate brass", None), (203, "red red red", "plate", "brass " * 3000)]


def test_covers_equal_the_sweep(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, a string, b string, c string")
    post = covers.positions(df, "id", {"a": ("A", F.col("a")), "b": ("B", F.col("b")), "c": ("D", F.col("c"))})
    vectors = {k: vector([("A", a), ("B", b), ("D", c)]) for k, a, b, c in data}
    assert sorted((r["doc"], r["term"], r["class"], r["pos"]) for r in post.collect()) == sorted((k, *w) for k, ws in vectors.items() for w in ws)
    for terms in (TERMS, TERMS[:2], ["brass"], ["red", "absent"], ["red", "red", "plate"]):
        got = covers.covers(covers.hits(post, terms), terms).collect()
        want = sorted((k, *c) for k, ws in vectors.items() for c in sweep(ws, terms))
        assert sorted((r["doc"], r["first"], r["last"], r["n"], round(r["density"], 9)) for r in got) == want
        ranks = {r["doc"]: round(r["rank"], 6) for r in covers.cover_rank(post, terms).collect()}
        assert ranks.keys() == {w[0] for w in want} and all(abs(v - sum(w[4] for w in want if w[0] == k)) < 1e-4 for k, v in ranks.items())
    anyone = {r["doc"]: round(r["rank"], 6) for r in covers.cover_rank(post, TERMS, every=False).collect()}
    assert anyone == {k: round(s, 6) for k, ws in vectors.items() if (s := sum(covers.WEIGHTS[c] for w, c, _ in ws if w in TERMS))}
    best = covers.best(covers.cover_rank(post, TERMS, every=False), 5, 0.5).collect()
    assert [r["doc"] for r in best] == [k for k, v in sorted(anyone.items(), key=lambda x: (-x[1], x[0])) if v >= 0.5][:5]


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    df = spark.createDataFrame(rows(), "id long, a string, b string, c string")
    covers.positions(df, "id", {"a": ("A", F.col("a"))}).write.partitionBy("bucket").parquet(str(tmp_path / "p"))
    post = spark.read.parquet(str(tmp_path / "p"))
    plan = covers.cover_rank(post, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_empty(spark):
    none = spark.createDataFrame([], "id long, a string")
    post = covers.positions(none, "id", {"a": ("A", F.col("a"))})
    assert covers.cover_rank(post, TERMS).count() == 0 and covers.cover_rank(post, TERMS, every=False).count() == 0
