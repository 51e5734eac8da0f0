"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts turns every document into a few statistics.  Standardised, they go through
cosines of random projections, whose inner products approximate a Gaussian kernel; tasks sum their parts
of the normal equations, and the ridge solution is found on the driver, whose work depends on the number of features
alone.  Scores of a fold that the regression did not see are counted in bins, and the isotonic
regression of the labels on the bins turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import textkernel as tk
from siltstone.llm.common import materialize, merge_slices, slices_of
from siltstone.llm.labelled import held, training_labels

FEATURES, RIDGE, BINS, CALIBRATION_FOLD = 384, 1.0, 512, 1
#: Raw scores are counted in bins between these.
LOW, HIGH = -0.5, 1.5

#: Byte classes whose shares of the text are statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\t\n\x0b\x0c\r ", b".,;:'\"?()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _k
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
#: Sums of a document: bytes, bytes of each class and of no class, lines, words, distinct words, repeats at distance
#: 1 and 2, words ending in a symbol or "!", words beginning with a capital, squared word lengths.
_SUMS = 2 + len(_CLASSES) + 1 + 7


def _sums(texts: pa.Array) -> np.ndarray:
    """Sums of whole texts; a long text is taken in segments, and what they share is settled over all of its words."""
    out = np.zeros((len(texts), _SUMS))
    c = 3 + len(_CLASSES)
    for row, end, data, offsets, cuts in tk.segments(texts, _NEWLINE):
        if not len(data):
            continue
        several, every = len(cuts) > 1, []
        for begin, stop in cuts:
            part = data[begin:stop]
            bounds = np.array([0, len(part)]) if several else offsets
            words, of = _add_sums(out[row:end], part, bounds)
            every.append(words)
        words = np.concatenate(every) if several else words
        of = np.zeros(len(words), dtype=np.int64) if several else of
        n = end - row
        for k in (1, 2):
            same = np.zeros(len(words), dtype=bool)
            same[k:] = (words[k:] == words[:-k]) & (of[k:] == of[:-k])
            out[row:end, c + 1 + k] = np.bincount(of[same], minlength=n)
        bounds = np.searchsorted(of, np.arange(n + 1))
        out[row:end, c + 1] = np.diff(tk.distinct(words.copy(), bounds)[1])
    return out


def _add_sums(out: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the sums that segments add up to, and returns the digests and rows of the words."""
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[full]
    add = np.zeros((len(full), _SUMS))
    add[:, 0] = np.diff(offsets)[full]
    kinds = _CLASS_OF[data]
    for k in range(len(_CLASSES) + 1):
        add[:, 1 + k] = np.add.reduceat((kinds == k).view(np.uint8), at, dtype=np.int64)
    add[:, 2 + len(_CLASSES)] = np.add.reduceat((data == 10).view(np.uint8), at, dtype=np.int64)
    starts, ends = tk.word_bounds(data, offsets)
    words = tk.digests(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    n, c = len(offsets) - 1, 3 + len(_CLASSES)
    of = np.repeat(np.arange(n), np.diff(bounds))
    count = lambda mask: np.bincount(of[mask], minlength=n)[full]
    add[:, c] = np.diff(bounds)[full]
    last = kinds[ends - 1]
    add[:, c + 4] = count((last == 5) | (last == 7))
    add[:, c + 5] = count(kinds[starts] == 0)
    add[:, c + 6] = np.bincount(of, weights=(ends - starts).astype(np.float64) ** 2, minlength=n)[full]
    out[full] += add
    return words, of


def _statistics(s: np.ndarray) -> np.ndarray:
    """Statistics of documents from their sums; all zero for an empty text."""
    size, words = np.maximum(s[:, :1], 1), np.maximum(s[:, 3 + len(_CLASSES)], 1)
    c = 3 + len(_CLASSES)
    mean = (s[:, 0] - s[:, 4]) / words
    per_word = s[:, [c + 2, c + 3, c + 4, c + 5]] / words[:, None]
    return np.column_stack(
        [np.log1p(s[:, 0]), np.log1p(s[:, c]), np.sqrt(s[:, 1 : 2 + len(_CLASSES)] / size), np.sqrt(s[:, c - 1] / words), np.sqrt(per_word),
         np.log1p(s[:, c + 1]) / np.log1p(words), mean, np.sqrt(np.maximum(s[:, c + 6] / words - mean**2, 0.0))]
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _statistics(_sums(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), lists], names=["id", "held_out", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _cosines(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    turns = rng.standard_normal((x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / deviation, -6, 6)
    return np.column_stack([np.cos(z @ turns + shift) * np.sqrt(2 / FEATURES), np.ones(len(x))])


def _equations(scale_of, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, deviation = scale_of.value
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = _cosines(_matrix(batch.column("x")), mean, deviation, seed)
                left += z.T @ z
                right += z.T @ batch.column("label").to_numpy().astype(np.float64)
        yield slices_of(np.concatenate([left.ravel(), right]), TaskContext.get().partitionId())

    return run


def _raw(model_of, seed: int, also: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, deviation, weights = model_of.value
        for batch in batches:
            raw = _cosines(_matrix(batch.column("x")), mean, deviation, seed) @ weights if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), pa.array(raw)], names=[*also, "raw"])

    return run


def isotonic(positions: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means closest to sums / counts, by pooling adjacent violators; one value per position."""
    blocks: list[list[float]] = []
    for s, n in zip(sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks]) if blocks else np.empty(0)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, seed: int = 11) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted, raw_score.

    score in [0, 1] is the calibrated probability of label 1; predicted is 1 from ``cut`` on.  All labelled rows outside
    the held-out fold are learned from: one fold calibrates, the others fit the regression.  A null or empty text has
    all statistics zero and is scored like any other.  Rows with null ids are scored and never learned from; rows
    that repeat an id are rows of their own; of an id's several labels the largest counts.  Without labels
    every score is 0.5.  Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held(id_col).alias("held_out"))
    measured = materialize(rows.mapInArrow(_measure, f"id {kind}, held_out boolean, x array<double>"), "measured")
    known = materialize(measured.join(training_labels(labels, id_col, label_col), "id").select("x", "label", "fold"), "known")
    fit = known.where(F.col("fold") != CALIBRATION_FOLD)

    width = len(_statistics(np.zeros((1, _SUMS)))[0])
    columns = [F.col("x")[k] for k in range(width)]
    moments = fit.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    if not moments[0]:
        return measured.select(F.col("id").alias(id_col), "held_out", F.lit(0.5).alias("score"), F.lit(int(cut <= 0.5)).alias("predicted"), F.lit(0.5).alias("raw_score"))
    mean, deviation = np.array(moments[1 : 1 + width]), np.maximum(np.array(moments[1 + width :]), 1e-3)
    scale = spark.sparkContext.broadcast((mean, deviation))
    summed = merge_slices(fit.select("x", "label").mapInArrow(_equations(scale, seed), "part long, slice int, data binary"), "sum")
    left = summed[: (FEATURES + 1) ** 2].reshape(FEATURES + 1, FEATURES + 1)
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[-1] = 0.0
    weights = np.linalg.solve(left + np.diag(penalty + 1e-9), summed[(FEATURES + 1) ** 2 :])
    model = spark.sparkContext.broadcast((mean, deviation, weights))

    seen = known.where(F.col("fold") == CALIBRATION_FOLD)
    seen = seen.select("x", "label").mapInArrow(_raw(model, seed, ["label"]), "label int, raw double")
    bin_of = F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("raw"))) - LOW) / (HIGH - LOW) * (BINS - 1))
    bins = sorted(seen.groupBy(bin_of.alias("bin")).agg(F.sum("label").alias("s"), F.count("*").alias("n"), F.avg("raw").alias("at")).collect())
    if bins:
        at = np.array([b["at"] for b in bins])
        level = isotonic(at, np.array([float(b["s"]) for b in bins]), np.array([float(b["n"]) for b in bins]))
    else:
        at, level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    curve = spark.sparkContext.broadcast((at, level))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, level = curve.value
        for batch in _raw(model, seed, ["id", "held_out"])(batches):
            score = np.clip(np.interp(batch.column("raw").to_numpy(), at, level), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["id", "held_out", "raw_score", "score"])

    scored = measured.mapInArrow(calibrate, f"id {kind}, held_out boolean, raw_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "raw_score")
