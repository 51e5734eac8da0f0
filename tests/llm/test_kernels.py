import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import textkernel as tk
from siltstone.llm.language_model import Lookup, _word_level
from siltstone.llm.quality import isotonic

TEXTS = ["a b c d", "A b  C\td", None, "", " \n", "é É a", "a", "x " * 50]


def words(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_shingle_sets_match_python(monkeypatch, piece):
    monkeypatch.setattr(tk, "PIECE_BYTES", piece)
    for width in (1, 3, 5):
        sizes = np.zeros(len(TEXTS), dtype=int)
        for row, end, _, bounds in tk.shingle_sets(pa.array(TEXTS), width):
            sizes[row:end] = np.diff(bounds)
        want = [len({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if (w := words(t)) else 0 for t in TEXTS]
        assert sizes.tolist() == want


def test_equal_words_have_equal_digests_in_any_piece(monkeypatch):
    whole = [w for *_, w, _ in tk.word_digests(pa.array(["the Cat the cat THE"]))][0]
    assert len(set(whole.tolist())) == 2
    monkeypatch.setattr(tk, "PIECE_BYTES", 5)
    cut = np.concatenate([w for *_, w, _ in tk.word_digests(pa.array(["the Cat the cat THE"]))])
    assert cut.tolist() == whole.tolist()


def test_slices_of_arrow_arrays():
    part = pa.array(["skip me", "a b", None, "c"]).slice(1)
    assert [np.diff(b).tolist() for *_, b in tk.word_digests(part)] == [[2, 0, 1]]
    assert list(tk.word_digests(pa.array([], pa.string()))) == []


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    keys = np.unique(keys)
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    assert (Lookup(keys[:0]).find(keys) == -1).all()


def test_word_level_is_normalised():
    rng = np.random.default_rng(2)
    counts, classes = rng.integers(1, 50, 40).astype(float), np.sort(rng.integers(0, 4, 40))
    logs = _word_level(rng.integers(0, 9, (40, 32)).astype(float), counts, classes)
    for c in np.unique(classes):
        assert np.allclose(np.exp(logs[classes == c]).sum(axis=0), 1)


def test_isotonic():
    got = isotonic(np.arange(5), np.array([1.0, 0, 2, 1, 3]), np.array([1.0, 1, 2, 2, 3]))
    assert np.allclose(got, [0.5, 0.5, 0.75, 0.75, 1.0]) and (np.diff(got) >= 0).all()
