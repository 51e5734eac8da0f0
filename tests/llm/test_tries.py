"""Resampling against a plain version, for runs of one to three words; tries that are turned in early; edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from siltstone.llm import tries
from siltstone.llm.tries import Trie, bucket_totals, gains, resample, words_of

SCHEMA = "doc_id long, text string, weight string, place int"


def features(text, most):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return [b" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)], len(words)


def plain(rows, items, most, buckets, least, percent):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x, most)[0]) for texts in ([x for _, x in rows], items))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for doc_id, text in rows:
        found, words = features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        scored.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = Counter((r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    ranked = Counter(r for (r, _) in rank.elements())
    return sorted(map(str, [(*r, k) for (r, k) in rank.elements()] + [(*r, None) for r in (Counter(x[:4] for x in scored) - ranked).elements()]))


def sample():
    words = ["Alpha", "beta", "GAMMA", "délta", "漢字", "x1", "42", "İx", "end"]
    rows = [(k, " ".join(words[(k * 7 + j * j) % len(words)] + (".,-" if j % 5 == 0 else "") for j in range(k % 40))) for k in range(150)]
    rows += [(None, "a b " * 15), (500, None), (501, ""), (502, "... --- \x00"), (503, "long Word " * 40_000), (7, "same id " * 20), (7, "same id " * 20)]
    return rows, ["alpha beta gamma", "délta x1 délta end", None, ""]


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (3, 97, 50), (2, 1000, 100)])
def test_equals_the_plain_version(spark, most, buckets, percent):
    rows, items = sample()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = resample(df, spark.createDataFrame([(x,) for x in items], "text string"), most=most, buckets=buckets, percent=percent).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows, items, most, buckets, 20, percent)


def test_a_trie_turned_in_early_counts_the_same(spark, monkeypatch):
    rows, _ = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = bucket_totals(df, "text", 3, 50)
    monkeypatch.setattr(tries, "MOST_NODES", 5)
    assert (bucket_totals(df, "text", 3, 50) == whole).all() and whole.sum() > 0


def test_nodes_hold_the_crc_of_their_path():
    trie = Trie(lambda state: state, 3)
    assert [n[0] for n in trie.paths(words_of(b"One two,THREE"))] == [zlib.crc32(x) for x in (b"one", b"one two", b"one two three", b"two", b"two three", b"three")]
    assert len(list(trie.nodes())) == trie.size == 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resample(none, none).collect() == [] and resample(some, none, percent=100).collect()[0]["rank"] == 1
    assert gains(bucket_totals(none, "text", 1, 4), bucket_totals(none, "text", 1, 4)) == [0, 0, 0, 0]
