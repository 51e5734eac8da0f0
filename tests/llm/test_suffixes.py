"""Repeats against brute force, the merge against sorting, hot beginnings, long texts in pieces, edges."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import suffixes
from siltstone.llm.suffixes import front_coded, decoded, merged, remove_repeats, shared_from


def plain(texts, length):
    """Spans of each text by looking at every string."""
    seen = {}
    for t, text in enumerate(texts):
        for at in range(len(text) - length + 1):
            seen.setdefault(text[at : at + length], []).append((t, at))
    covered = [bytearray(len(text)) for text in texts]
    for places in seen.values():
        for t, at in places if len(places) > 1 else ():
            covered[t][at : at + length] = b"\1" * length
    spans = []
    for mask in covered:
        edges = [k for k in range(len(mask) + 1) if (mask[k] if k < len(mask) else 0) != (mask[k - 1] if k else 0)]
        spans.append(list(zip(edges[::2], edges[1::2])))
    return spans


def corpus(seed, n, letters="abcdefghij é"):
    r = random.Random(seed)
    passages = ["".join(r.choice(letters) for _ in range(r.randrange(5, 120))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [r.choice(passages)[r.randrange(3) :] if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(r.randrange(6))]
        rows.append("".join(parts))
    return [*rows, rows[0], rows[0], "", None, "a" * 150, "ab" * 60, "漢字" * 30, passages[0] * 4]


def check(spark, texts, length, **more):
    rows = [(k if k % 7 else None, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, first int").repartition(4)
    got = remove_repeats(df, length=length, **more).collect()
    raw = [(t or "").encode() for t in texts]
    want = []
    for (doc_id, *_), text, spans in zip(rows, raw, plain(raw, length), strict=True):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        want.append(str((doc_id, len(text), sum(b - a for a, b in spans), spans, kept + text[at:])))
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))) for r in got) == sorted(want)


@pytest.mark.parametrize("length,seed", [(1, 1), (2, 2), (3, 3), (7, 4), (20, 5), (20, 6), (50, 7), (64, 8)])
def test_equals_brute_force(spark, length, seed):
    check(spark, corpus(seed, 40), length)


@pytest.mark.parametrize("hot,length", [(1, 20), (3, 30)])
def test_hot_beginnings_equal_brute_force(spark, hot, length):
    check(spark, corpus(hot, 40), length, hot=hot)


def test_small_pieces_runs_and_levels(spark, monkeypatch):
    for name, value in (("PIECE_BYTES", 64), ("RUN_BYTES", 2000), ("LEVEL_ROWS", 4), ("PART_BYTES", 3000), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(suffixes, name, value)
    check(spark, corpus(11, 40), 24)


def test_common_passage_with_other_surroundings(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage, short = word(130), word(90)
    texts = [word(50) + passage + word(50) for _ in range(60)] + [word(60) + short + word(60) for _ in range(60)] + [word(5) + short + "tail" + word(30), word(9) + short + "tail" + word(30)]
    check(spark, texts, 94)
    check(spark, texts, 94, hot=10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6) | st.text("ab", max_size=200).map(str.encode)), max_size=7))
def test_merge_of_front_coded_runs(lists):
    runs = [sorted(x) for x in lists]
    got = list(merged([decoded(*front_coded(x)) for x in runs])) if runs else []
    keys = [k for _, _, k in got]
    assert keys == sorted(k for x in runs for k in x)
    assert [s for _, s, _ in got] == [shared_from(a, b, 0) for a, b in zip([b"", *keys], keys)]
    assert [[k for n, _, k in got if n == run] for run in range(len(runs))] == runs


def test_empty_tables_and_short_texts(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = remove_repeats(spark.createDataFrame([(1, "x" * 399), (2, "x" * 399), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], len(r["kept"])) for r in got) == [(1, 0, 399), (2, 0, 399), (3, 0, 0)]
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=0)
