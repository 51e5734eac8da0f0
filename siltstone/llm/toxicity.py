"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is toxic unless every sentence is clean: P(doc) = 1 - prod(1 - p_s) (noisy-or), where p_s is a logistic
score of the words and word beginnings of sentence s.  First, one pass over the sample counts in how many toxic and
other documents each hashed feature occurs; the features that go with toxic documents beyond chance are
kept.  Then the noisy-or likelihood is climbed in rounds: each task makes gradient steps over its documents
from the common weights, and the tasks' weights are averaged by their documents.  Scoring reads whole
texts; sentences of high p_s are located.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import textkernel as tk
from siltstone.llm.common import materialize, merge_slices, slices_of, sparse_slices_of
from siltstone.llm.labelled import held, training_labels

#: At most about this many labelled rows are learned from, chosen by a hash of their ids.
SAMPLE_ROWS = 16_384
BITS, KEPT, ROUNDS, STEPS = 20, 4096, 3, 40
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: A feature is kept if its likelihood ratio against chance reaches this (a chance of one in millions).
LEAST_RATIO = 25.0
START_BIAS = -6.0

_BLANK = np.ones(256, dtype=bool)
_BLANK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, the sentence of each word, and the first word of each sentence."""
    starts, ends = tk.word_bounds(data, offsets, _BLANK)
    if not len(starts):
        return starts, ends, starts, starts
    row = np.searchsorted(offsets, starts, side="right")
    stops = np.cumsum(_STOP[data])[starts]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])])
    return starts, ends, np.cumsum(new) - 1, np.flatnonzero(new)


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, buckets) for whole words and for each length of beginning."""
    shift = np.uint64(64 - BITS)
    out = [(np.arange(len(starts)), (tk.digests(data, starts, ends) >> shift).astype(np.int64))]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        begun = tk.mix(tk.digests(data, starts[long], starts[long] + k) + np.uint64(k))
        out.append((long, (begun >> shift).astype(np.int64)))
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic documents, then other documents, in which each bucket occurs."""
    counts = np.zeros(2 << BITS, dtype=np.uint32)
    for batch in batches:
        label = batch.column("label").to_numpy()
        for row, _, data, offsets, cuts in tk.segments(batch.column("text"), _STOP):
            pairs = np.empty(0, dtype=np.int64)
            for begin, stop in cuts:
                part, bounds = data[begin:stop], offsets if len(cuts) == 1 else np.array([0, stop - begin])
                starts, ends, *_ = _sentences(part, bounds)
                of = np.searchsorted(bounds, starts, side="right") - 1
                pairs = np.unique(np.concatenate([pairs, *((of[w] << BITS) | b for w, b in _buckets(part, starts, ends))]))
            other = (label[row + (pairs >> BITS)] != 1).astype(np.int64)
            np.add.at(counts, (pairs & ((1 << BITS) - 1)) + (other << BITS), np.uint32(1))
    yield sparse_slices_of(counts, TaskContext.get().partitionId())


def _likelihood_ratio(pos: np.ndarray, neg: np.ndarray, positive: int, other: int) -> np.ndarray:
    """Twice the log likelihood ratio of the two-by-two table of feature and label."""
    seen, every = pos + neg, positive + other
    out = np.zeros(len(pos))
    for part, row, column in ((pos, seen, positive), (neg, seen, other), (positive - pos, every - seen, positive), (other - neg, every - seen, other)):
        out += 2 * part * np.log(np.maximum(part, 1e-12) * every / np.maximum(row * column, 1e-12))
    return out


def _chosen(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Kept features met, as sentence * KEPT + feature, first and last byte of each sentence, and whether a stop leads."""
    starts, ends, sentence, first = _sentences(data, offsets)
    met = []
    for w, b in _buckets(data, starts, ends):
        f = table[b]
        ok = np.flatnonzero(f >= 0)
        met.append(sentence[w[ok]].astype(np.int64) * KEPT + f[ok])
    last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(first) else first
    led = bool(len(starts)) and bool(_STOP[data[: starts[0]]].any())
    return np.concatenate(met), starts[first], ends[last], led


def _read(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets, sentence and kept feature of each pair, row, begin and stop of each sentence).

    A sentence that goes over the segments of a long row is one sentence.
    """
    for row, end, data, offsets, cuts in tk.segments(texts, _STOP):
        if len(cuts) == 1:
            met, begin, stop, _ = _chosen(data, offsets, table)
        else:
            mets, begins, stops, n, goes_on = [], [], [], 0, False
            for a, b in cuts:
                met, begin, stop, led = _chosen(data[a:b], np.array([0, b - a]), table)
                if not len(begin):
                    goes_on = goes_on and not _STOP[data[a:b]].any()
                    continue
                join = goes_on and not led
                mets.append(met + (n - join) * KEPT)
                if join:
                    stops[-1][-1] = a + stop[0]
                if len(stop) > join:
                    begins.append(a + begin[int(join) :])
                    stops.append(a + stop[int(join) :])
                n += len(begin) - join
                goes_on = not _STOP[data[a + stop[-1] : b]].any()
            met, begin, stop = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (mets, begins, stops))
        met = np.unique(met)
        yield row, end, data, offsets, met // KEPT, met % KEPT, row + np.searchsorted(offsets, begin, side="right") - 1, begin, stop


def _bags(table_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of.value
        for batch in batches:
            label = batch.column("label").to_numpy()
            for row, end, _, _, sentence, feature, of, _, _ in _read(batch.column("text"), table):
                rows = []
                for r in range(row, end):
                    a, b = np.searchsorted(of, [r, r + 1])
                    lo, hi = np.searchsorted(sentence, [a, b])
                    _, sizes = np.unique(sentence[lo:hi], return_counts=True)
                    rows.append((int(label[r]), int(b - a - len(sizes)), sizes.tolist(), feature[lo:hi].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["label", "plain", "sizes", "features"])

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _climb(weights_of, steps: int):
    """Adagrad steps over a task's documents; yields its weights times its documents, and the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights_of.value
        rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        if not rows:
            return
        y = np.array([r[0] == 1 for r in rows])
        plain = np.array([r[1] for r in rows], dtype=np.float64)
        sizes = np.array([s for r in rows for s in r[2]], dtype=np.int64)
        features = np.array([f for r in rows for f in r[3]], dtype=np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        w = start.copy()
        moved = np.full(len(w), 1e-2)
        for _ in range(steps):
            z = w[-1] + np.bincount(sentence, weights=w[features], minlength=len(sizes))
            clean = -np.bincount(doc, weights=_softplus(z), minlength=len(rows)) - plain * _softplus(w[-1])
            toxic = -np.expm1(clean)
            pull = np.where(y, np.exp(clean) / np.maximum(toxic, 1e-9), -1.0)
            dz = np.exp(z - _softplus(z)) * pull[doc]
            g = np.bincount(features, weights=dz[sentence], minlength=len(w)).astype(np.float64)  # of no features it is whole numbers
            g[-1] = dz.sum() + (np.exp(w[-1] - _softplus(w[-1])) * plain * pull).sum()
            g -= 0.02 * (w - np.where(np.arange(len(w)) == len(w) - 1, START_BIAS, 0.0))
            moved += g * g
            w += 0.3 * g / np.sqrt(moved)
            w[:-1] = np.maximum(w[:-1], 0.0)  # a feature is evidence for toxicity or none
        yield slices_of(np.concatenate([w * len(rows), [float(len(rows))]]), TaskContext.get().partitionId())

    return run


def _scored(model_of, locate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = model_of.value
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            n = batch.num_rows
            clean, count, found = np.zeros(n), np.zeros(n, dtype=np.int64), [[] for _ in range(n)]
            for row, _, data, offsets, sentence, feature, of, begin, stop in _read(batch.column("text"), table):
                z = w[-1] + np.bincount(sentence, weights=w[feature], minlength=len(begin))
                clean -= np.bincount(of, weights=_softplus(z), minlength=n)
                count += np.bincount(of, minlength=n)
                p = np.exp(z - _softplus(z))
                hot = np.flatnonzero(p >= locate)
                if len(hot):
                    base = tk.chars_before(data, offsets[of[hot] - row])
                    spans = zip(of[hot].tolist(), tk.chars_before(data, begin[hot]) - base, tk.chars_before(data, stop[hot]) - base, p[hot].tolist(), strict=True)
                    for r, a, b, score in spans:
                        found[r].append({"start": int(a), "end": int(b), "score": score})
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(-np.expm1(np.minimum(clean, 0.0))), pa.array(count), pa.array(found, spans_type)], names=["id", "held_out", "score", "n_sentences", "spans"])

    return run


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.5, locate: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted, n_sentences, spans.

    score is P(toxic) in [0, 1]; predicted is 1 from ``cut`` on; spans are the character ranges and scores of the
    sentences with p_s >= ``locate``.  Only texts of at most about ``sample_rows`` labelled rows outside the held-out fold
    are learned from.  A null, empty or wordless text has score 0 and no sentence.  Rows with null ids are scored
    and never learned from; rows that repeat an id are rows of their own; of an id's several labels the largest counts.
    Without toxic labels, without others, or if no feature tells them apart, every score is 0.  Labels of a repeated id
    count once, with the row of the smallest text digest.  Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = _trained(rows, labels, id_col, label_col, sample_rows)
    scored = rows.withColumn("held_out", held("id")).mapInArrow(_scored(model, locate), f"id {kind}, held_out boolean, score double, n_sentences long, spans array<struct<start:long,end:long,score:double>>")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_sentences", "spans")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df``, all columns, whose score stays below ``cut``; scored where they are read, without a shuffle."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = _trained(rows, labels, id_col, label_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = model.value
        for batch in batches:
            clean = np.zeros(batch.num_rows)
            for *_, sentence, feature, of, begin, _ in _read(batch.column(batch.num_columns - 1), table):
                z = w[-1] + np.bincount(sentence, weights=w[feature], minlength=len(begin))
                clean -= np.bincount(of, weights=_softplus(z), minlength=batch.num_rows)
            keep = pa.array(-np.expm1(np.minimum(clean, 0.0)) < cut)
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    # Positional names, as columns of ``df`` may have any; the text goes along once more as the last column.
    plain = [f"c{k}" for k in range(len(df.columns))]
    cast = df.toDF(*plain)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema.fields, strict=True))
    at = df.columns.index(text_col)
    return cast.withColumn("text_again", F.col(plain[at]).cast("string")).mapInArrow(run, schema).toDF(*df.columns)


def _trained(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int):
    """Broadcast (bucket -> kept feature, weights and bias)."""
    spark = rows.sparkSession
    known = training_labels(labels, id_col, label_col)
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    known = known.where(F.expr(f"pmod(xxhash64(id), 1000000) < {int(share * 1_000_000)}"))
    sample = rows.join(F.broadcast(known.select("id", "label")), "id").groupBy("id")
    sample = materialize(sample.agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("r")).select("r.*"), "labelled")

    slices = "part long, slice int, data binary"
    counts = merge_slices(sample.mapInArrow(_presence, slices), "sparse").astype(np.float64)
    positive, every = sample.agg(F.expr("count_if(label = 1)"), F.count("*")).first()
    other = every - positive
    table, weights = np.full(1 << BITS, -1, dtype=np.int16), np.array([-1000.0])
    if positive and other:
        pos, neg = counts[: 1 << BITS], counts[1 << BITS :]
        ratio = _likelihood_ratio(pos, neg, positive, other)
        kept = np.flatnonzero((ratio >= LEAST_RATIO) & (pos * other > neg * positive))
        kept = kept[np.argsort(-ratio[kept], kind="stable")][:KEPT]
    if positive and other and len(kept):
        table[kept] = np.arange(len(kept), dtype=np.int16)
        odds = np.log((pos[kept] + 0.5) / (positive + 1)) - np.log((neg[kept] + 0.5) / (other + 1))
        weights = np.concatenate([0.5 * odds, [START_BIAS]])
        table_of = spark.sparkContext.broadcast(table)
        bags = materialize(sample.mapInArrow(_bags(table_of), "label int, plain int, sizes array<int>, features array<int>"), "bags")
        for _ in range(ROUNDS):
            summed = merge_slices(bags.mapInArrow(_climb(spark.sparkContext.broadcast(weights), STEPS), slices), "sum")
            if len(summed):
                weights = summed[:-1] / summed[-1]
    return spark.sparkContext.broadcast((table, weights))
