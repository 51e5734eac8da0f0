"""Cuts against a plain version over code points, other units and marks, nulls, long texts, clashing names."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm.fill_middle import MARKS, count_units, cut_at, fill_in_middle, restored

TEXTS = [None, "", "a", "ab", "<", "x<P>y", "<S>", "a<M", "<<", "<<<S", "é😀漢字" * 40, "two words here", "long " * 60_000, "a\nb\r\nc\n", "same", "same"]


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{doc_id if doc_id is not None else ''}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_cuts_equal_the_plain_version(spark):
    rows = [(k, TEXTS[k % len(TEXTS)], "clash", 1) for k in range(200)] + [(None, "without an id", "clash", 1), (7, "an id again", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got])) == sorted(
        map(str, [(i, *plain(i, t), t or "") for i, t, _, _ in rows])
    )
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_units_and_marks(spark):
    df = spark.createDataFrame([(k, f"  head {'w ' * k} tail {k}  ") for k in range(60)], "doc_id int, text string")
    marks = ("[P]", "{S}", "(M)")
    got = fill_in_middle(df, unit=r"\S+|x*", seed="s", transformed=100, suffix_first=50, marks=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    texts = {k: f"  head {'w ' * k} tail {k}  " for k in range(60)}
    for r in got:
        assert r["n"] == len(texts[r["doc_id"]].split()) and r["back"] == texts[r["doc_id"]] and r["form"] != "plain"
        # A cut is at the end of a word, or at the beginning of the text.
        for end in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
            assert end == 0 or end in [m.end() for m in re.finditer(r"\S+", texts[r["doc_id"]])]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=30), st.sampled_from([r"(?s:.)", r"\w+", r"[^\n]*\n?", r"a?"]), st.integers(0, 99), st.integers(0, 99))
def test_the_second_pass_reaches_both_ranks(text, unit, x, y):
    pattern = re.compile(unit)
    ends = [0] + [m.end() for m in pattern.finditer(text) if m.group()]
    assert count_units(pattern, text) == len(ends) - 1
    low, high = sorted((x % len(ends), y % len(ends)))
    assert cut_at(pattern, text, low, high) == (ends[low], ends[high])


def test_marks_that_could_not_be_read_back_are_refused(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(df).collect() == []
    for marks in (("<P>", "<S>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(df, marks=marks)
