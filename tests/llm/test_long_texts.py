"""Texts beyond the working piece give what they would give whole."""

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import quality, toxicity
from siltstone.llm import textkernel as tk

WORDS = ["alpha", "beta", "ünï", "gam.ma", "x!", "delta?", "\n", "kill", "die  "]


def texts():
    rng = np.random.default_rng(0)
    long = " ".join(rng.choice(WORDS, 900))
    bare = "".join(c for c in long if c not in ".!?\n")
    return [" ".join(rng.choice(WORDS, 3)), "", None, long, "longword" * 100 + " a.b " + "tail" * 90, bare, "...." * 60 + "a b", "a b " * 60 + "... c d " * 40]


def sentences(some):
    table = (np.arange(1 << toxicity.BITS) % toxicity.KEPT).astype(np.int16)
    out = []
    for row, _, data, offsets, sentence, feature, of, begin, stop in toxicity._read(pa.array(some), table):
        base = tk.chars_before(data, offsets[of - row])
        places = zip(of.tolist(), tk.chars_before(data, begin) - base, tk.chars_before(data, stop) - base, strict=True)
        out += [(r, int(a), int(b), sorted(feature[sentence == k].tolist())) for k, (r, a, b) in enumerate(places)]
    return out


@pytest.mark.parametrize("size", [64, 128, 1000])
def test_segments_change_nothing(monkeypatch, size):
    whole, sums = sentences(texts()), quality._sums(pa.array(texts()))
    monkeypatch.setattr(tk, "PIECE_BYTES", size)
    assert sentences(texts()) == whole and np.array_equal(quality._sums(pa.array(texts())), sums)


def test_distinct_words_of_a_long_text():
    sums = quality._sums(pa.array([" ".join(f"w{k % 500}" for k in range(400_000))]))
    assert sums[0, 3 + len(quality._CLASSES) + 1] == 500
