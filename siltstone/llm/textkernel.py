"""Vectorised text kernels shared by the Arrow-backed operators of this subpackage.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased; both rules touch
ASCII bytes only, so they are applied to UTF-8 buffers without decoding.  A word's 64-bit digest is a
polynomial over random byte values (difference of two prefix sums, shifted back by the inverse power),
finished by a bijective mixer: no Python object is made for a word.  Texts are taken in pieces of at most
``PIECE_BYTES`` (a longer text is cut at white space), so working memory does not grow with a text beyond
eight bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once; working memory is about 60 times that.
PIECE_BYTES = 1 << 19

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
    for c in range(ord("A"), ord("Z") + 1):
        values[c] = values[c + 32]
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


_VALUES, _SPACE = _tables()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [
                np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b & (2**64 - 1), dtype=np.uint64))])
                for b in (_BASE, pow(_BASE, -1, 2**64))
            ]
    return _POWERS[0], _POWERS[1]


def word_bounds(data: np.ndarray, cuts: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses one of the ascending positions ``cuts``.

    ``blank`` marks the bytes between words, by default white space.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside = ~(_SPACE if blank is None else blank)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than there are rows) and bytes; a null has no bytes."""
    if pa.types.is_null(texts.type):
        return np.zeros(len(texts) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them) of at most PIECE_BYTES, or of one long row."""
    offsets, data = _buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segments(texts: pa.Array, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """As pieces, with the segments (begin, end) in which the bytes are to be taken: one, or several of a long row.

    A segment of a long row ends after its last byte that ``ends`` marks, else after its last white space; without
    either it grows until there is one, so no word is ever cut.
    """
    for row, end, data, offsets in pieces(texts):
        cuts, at = [0], 0
        while len(data) - at > PIECE_BYTES:
            size = PIECE_BYTES
            while True:
                window = data[at : at + size]
                stops = np.flatnonzero(ends[window])
                stops = stops if len(stops) else np.flatnonzero(_SPACE[window])
                if len(stops) or at + size >= len(data):
                    break
                size *= 2
            at = at + int(stops[-1]) + 1 if len(stops) else len(data)
            cuts.append(at)
        if cuts[-1] < len(data) or len(cuts) == 1:
            cuts.append(len(data))
        yield row, end, data, offsets, list(zip(cuts[:-1], cuts[1:], strict=True))


def chars_before(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Characters of UTF-8 ``data`` before each of the ascending byte positions, counted piece by piece."""
    out, at, count = np.empty(len(positions), dtype=np.int64), 0, 0
    for k, p in enumerate(positions.tolist()):
        while at < p:
            to = min(p, at + PIECE_BYTES)
            count += int(np.count_nonzero((data[at:to] & 0xC0) != 0x80))
            at = to
        out[k] = count
    return out


def _long_words(data: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            blanks = np.flatnonzero(_SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1])
                break
            end = min(end + PIECE_BYTES, len(data))
        part = data[at:end]
        out.append(digests(part, *word_bounds(part, np.empty(0, dtype=np.int64))))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def word_digests(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, digests of their words, word offsets of the rows), piece by piece."""
    for row, end, data, offsets in pieces(texts):
        if len(data) > PIECE_BYTES:
            words = _long_words(data)
            yield row, end, words, np.array([0, len(words)])
        else:
            starts, ends = word_bounds(data, offsets)
            yield row, end, digests(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of every run of ``width`` words inside a row (a shorter row: of all its words), and row offsets."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, counts > 0)
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    if not len(words):
        return words, out_bounds
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out_bounds[-1]) - out_bounds[rows] + bounds[rows]
    size = np.minimum(counts, width)[rows]
    out = size.astype(np.uint64)
    short = counts[rows] < width
    any_short = bool(short.any())
    for k in range(width):
        nxt = mix(out * _M1 + words[np.minimum(at + k, len(words) - 1)])
        out = np.where(k < size, nxt, out) if any_short else nxt
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and row offsets.  ``values`` is overwritten."""
    n = len(values)
    if not n:
        return values, bounds
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        values[a:b].sort()
    new = np.ones(n, dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingle sets, row offsets), piece by piece."""
    for row, end, words, bounds in word_digests(texts):
        yield row, end, *distinct(*shingles(words, bounds, width))
