"""Hashed maximum-entropy language model with class-factored softmax.

Outcomes.  The ``HEAD`` most frequent training words (the end mark among them) are outcomes of their own, the
others share the *tail* class, inside which a word of count c has probability (c + 1) / Z and all unknown
words together 1 / Z.  Head words are grouped into classes by k-means over the words that precede them, so the
probabilities of all words and "unknown" sum to one after any history:

    P(w | h) = P(class | h) * P(w | class, class of the word before)

Class level: a softmax over hashed features of the words at -1 (bigram), -2 (skip) and (-2, -1) (trigram), whose
buckets grow with the square root of the training tokens, from 2^13 to 2^18 a template, twice as many for trigrams.
Training documents are dealt into ``ROUNDS`` parts; in a round each task makes gradient updates in mini-batches
over its documents of that part, starting from the common weights, and the tasks' updates are averaged by the
times that each feature was seen.  Every training document is used once.  Word level: a softmax whose features
are (word) and (word, class before); its gradient needs only pair counts, which tasks sum over all
training documents, so it is climbed to convergence on those sums.

Counts of all words stay distributed.  A table of the most frequent words, at most ``TABLE`` of them, is broadcast;
tokens outside it are joined with the counts by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import textkernel as tk
from siltstone.llm.common import SLICE_BYTES, held_out, lists_of, materialize, merge_slices, slices_of, wide_slices_of

HEAD, TABLE, CLASSES, CONTEXTS, ROUNDS = 1 << 15, 1 << 20, 32, 32, 3
BATCH = 1 << 15
#: Least and most buckets of the bigram and skip features as bits, of which half those of the training tokens and so
#: many more are taken; trigrams have one bit more.
MIN_BITS, MAX_BITS, GROWTH = 13, 18, 2
END = np.uint64(0x9D5C1F27E3B80A41)


class Lookup:
    """Positions of 64-bit keys by open addressing; vectorised, at most half full."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None) -> None:
        self.keys, bits = keys, max(4, math.ceil(math.log2(2 * len(keys) + 2)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        if slots is not None:
            self.slots = slots
            return
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        at, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        at, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            at, left = (at[on] + 1) & self.mask, left[on]
        return out


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_digests, with an end mark after each row's words."""
    for row, end, words, bounds in tk.word_digests(texts):
        yield row, end, np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(words)
        order = np.argsort(every)
        every, weight = every[order], np.concatenate(counts)[order]
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[new], np.add.reduceat(weight, new)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words[0].view(np.int64)), pa.array(counts[0])], names=["word", "n"])

    for batch in batches:
        for *_, tokens, _ in _tokens(batch.column("text")):
            if not len(tokens):
                continue
            w, n = np.unique(tokens, return_counts=True)
            words.append(w)
            counts.append(n)
            size += len(w)
            if size > 1_500_000:
                w, n = merged()
                words, counts, size = [w], [n], len(w)
                if size > 1_000_000:  # bounded memory: the rest is summed after the shuffle
                    yield out()
                    words, counts, size = [], [], 0
    if words:
        w, n = merged()
        words, counts = [w], [n]
        yield out()


class _Tally:
    """Counts of keys below ``size``, added up in large portions."""

    def __init__(self, size: int) -> None:
        self.counts, self.wait, self.waiting = np.zeros(size, dtype=np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.wait.append(keys)
        self.waiting += len(keys)
        if self.waiting > 2 * len(self.counts):
            self.total()

    def total(self) -> np.ndarray:
        if self.wait:
            self.counts += np.bincount(np.concatenate(self.wait), minlength=len(self.counts))
            self.wait, self.waiting = [], 0
        return self.counts


def _history(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words at -1 and -2; before a document stand end marks."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[bounds[:-1]] = END
    two[bounds[:-1]] = END
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = END
    return one, two


def _bits(tokens: int) -> int:
    """Bits of the bigram and skip buckets after so many training tokens."""
    return min(MAX_BITS, max(MIN_BITS, round(math.log2(tokens + 1) / 2) + GROWTH))


def _rows(bits: int) -> int:
    """Rows of the weights: the bias, then the bigram, skip and trigram buckets."""
    return 1 + (4 << bits)


def _features(one: np.ndarray, two: np.ndarray, bits: int) -> list[np.ndarray]:
    """Row of each feature in the weights, by template."""
    shift, start = np.uint64(64 - bits), 1 << bits
    return [
        (one >> shift).astype(np.int32) + np.int32(1),
        (tk.mix(two + np.uint64(7)) >> shift).astype(np.int32) + np.int32(1 + start),
        (tk.mix(one * np.uint64(0x9E3779B97F4A7C15) + two) >> (shift - np.uint64(1))).astype(np.int32) + np.int32(1 + 2 * start),
    ]


def _log_softmax(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    z = weights[features[0]]
    z += weights[features[1]]
    z += weights[features[2]]
    z += weights[0]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _order(rows: np.ndarray) -> np.ndarray:
    """Stable order of rows below 2^24, by two radix passes."""
    low = np.argsort(rows.astype(np.uint16), kind="stable")
    return low[np.argsort((rows[low] >> 16).astype(np.uint8), kind="stable")]


def _update(weights: np.ndarray, seen: np.ndarray, features: list[np.ndarray], classes: np.ndarray, rate: float) -> None:
    """One gradient step on a mini-batch; a feature moves by its mean gradient, less if it was hardly seen."""
    step = -np.exp(_log_softmax(weights, features))
    step[np.arange(len(classes)), classes] += 1
    weights[0] += rate * step.mean(axis=0)
    seen[0] += len(classes)
    for f in features:
        order = _order(f)
        at = f[order]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        times = np.diff(np.concatenate([new, [len(at)]]))
        at = at[new]
        weights[at] += np.add.reduceat(step[order], new, axis=0) * (rate / (times + 3.0)).astype(np.float32)[:, None]
        seen[at] += times


def _cluster(pairs: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Classes of head words by k-means over square roots of the shares of preceding words; the end is alone in 0."""
    share = pairs + 0.05 * pairs.sum(axis=0) / max(pairs.sum(), 1)
    points = np.sqrt(share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9))
    order = [k for k in np.argsort(-counts, kind="stable").tolist() if k != end]
    k = min(CLASSES - 2, len(order))
    if not k:
        return np.zeros(len(counts), dtype=np.int64)
    sample = points[order[:2048]]  # seeds far apart, from the most frequent words
    seeds, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(seeds) < k:
        seeds.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[seeds[-1]]) ** 2).sum(axis=1))
    centres = sample[seeds].copy()
    weight = np.sqrt(counts)
    for _ in range(12):
        found = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)
        for c in range(k):
            own = found == c
            if own.any():
                centres[c] = np.average(points[own], axis=0, weights=weight[own])
    classes = found + 1
    classes[end] = 0
    return classes


def _word_level(pairs: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(word | its class, class before), shape (words, CLASSES), by gradient ascent on pair counts."""
    base = np.log(counts + 1.0)[:, None]
    logits = np.repeat(base, CLASSES, axis=1)
    order = np.argsort(classes, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(classes[order]) > 0]))
    back = np.empty(len(classes), dtype=np.int64)
    back[order] = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(order)]])))

    def normal(x: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(x[order], new, axis=0)[back]
        return x - top - np.log(np.add.reduceat(np.exp(x - top)[order], new, axis=0))[back]

    totals = np.add.reduceat(pairs[order], new, axis=0)[back]
    for _ in range(25):
        expected = totals * np.exp(normal(logits))
        pull = 4.0 * (base - logits)  # keeps rare pairs near the word's own frequency
        logits += 0.9 * (pairs - expected + pull) / (np.maximum(pairs, expected) + 5.0)
    return normal(logits)


def _classes_of(found: np.ndarray, head: int, classes: np.ndarray) -> np.ndarray:
    return np.where((found >= 0) & (found < head), classes[np.clip(found, 0, head - 1)], CLASSES - 1)


def _score(model_of):
    """model_of: broadcast plain arrays, bounded by HEAD, TABLE and MAX_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots, counts, n_head, classes, bits, weights, words, tail, denominator = model_of.value
        table = Lookup(keys, slots)
        logs = np.log10(counts + 1.0)
        ln10 = math.log(10)
        for batch in batches:
            for row, end, tokens, bounds in _tokens(batch.column("text")):
                found = table.find(tokens)
                listed = found >= 0
                head = listed & (found < n_head)
                own = np.where(listed, logs[np.maximum(found, 0)], 0.0)
                kind = _classes_of(found, n_head, classes)
                before = np.empty_like(kind)
                before[1:] = kind[:-1]
                before[bounds[:-1]] = 0
                log_p = np.empty(len(tokens))
                one, two = _history(tokens, bounds)
                features = _features(one, two, bits)
                for a in range(0, len(tokens), BATCH):
                    part = slice(a, a + BATCH)
                    z = _log_softmax(weights, [f[part] for f in features])
                    log_p[part] = z[np.arange(len(z)), kind[part]] / ln10
                log_p[head] += words[found[head], before[head]] / ln10
                log_p[~head] += own[~head] - tail
                first = bounds[:-1]
                rare = np.concatenate([[0], np.cumsum(~listed)])[bounds]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, end - row),
                        batch.column("held").slice(row, end - row),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.add.reduceat(listed.astype(np.int64), first)),
                        pa.array(np.add.reduceat(own, first) - n * denominator),
                        pa.array(np.add.reduceat(log_p, first)),
                        pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(tokens[~listed].view(np.int64))),
                    ],
                    names=["id", "held", "n_tokens", "known", "base", "score", "rare"],
                )

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, head_words: int = HEAD, table_words: int = TABLE) -> DataFrame:
    """Train on the rows whose crc32(id as text) mod ``modulus`` is not ``remainder`` and score all rows.

    Returns one row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Tokens are the words of the whole text with A-Z lower-cased, then one end mark; a null, empty or blank text
    has the end mark alone.  base_score adds log10((c + 1) / (N + V + 1)); score is the model's log10
    probability.  A null id is trained on; rows that repeat an id are rows of their own.  With no training
    row, N = V = 0 and every score is that of unknown tokens.  Other columns are not read.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col), modulus, remainder).alias("held"))
    train = df.where("not held")
    counts = materialize(train.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    denominator = math.log10(total + distinct + 1)

    # The table: all words of at least such a count that there are at most table_words of them.
    bins = sorted(((r["bin"], r["words"]) for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, room = 100_001, table_words
    for count, words in bins:
        room -= words
        if room < 0:
            break
        least = count
    end = int(np.array([END]).view(np.int64)[0])
    listed = counts.where((F.col("n") >= least) | (F.col("word") == end)).toArrow()
    keys, numbers = listed.column("word").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    order = np.lexsort((keys, -numbers))
    keys, numbers = keys[order], numbers[order].astype(np.float64)
    head = min(head_words, len(keys))
    if len(keys):  # the end mark is always in the head
        at = int(np.flatnonzero(keys == END)[0])
        swap = min(at, head - 1)
        keys[[at, swap]], numbers[[at, swap]] = keys[[swap, at]], numbers[[swap, at]]
        end_at = swap
    table = Lookup(keys[:head])
    shared = spark.sparkContext.broadcast

    # Which words precede which: the classes.  Updates and pair counts have the same size whatever a task reads, so
    # fewer and larger tasks gather them.
    tasks = max(2 * spark.sparkContext.defaultParallelism, train.rdd.getNumPartitions() // 4)
    table_of = shared((table.keys, table.slots))

    def preceding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = Lookup(*table_of.value).find, _Tally(head * CONTEXTS)
        for batch in batches:
            for *_, tokens, bounds in _tokens(batch.column("text")):
                found = find(tokens).astype(np.int64)
                before = np.empty_like(found)
                before[1:] = found[:-1]
                before[bounds[:-1]] = -1
                before = np.where((before < 0) | (before >= CONTEXTS - 1), CONTEXTS - 1, before)
                ok = found >= 0
                held.add((found[ok] * CONTEXTS + before[ok]).astype(np.int32))
        yield wide_slices_of(held.total(), TaskContext.get().partitionId())

    slices = "part long, slice int, data binary"
    if head:
        pairs = merge_slices(train.select("text").coalesce(tasks).mapInArrow(preceding, slices), "wide")
        classes = _cluster(pairs.reshape(head, CONTEXTS).astype(np.float64), numbers[:head], end_at)
    else:
        classes = np.zeros(1, dtype=np.int64)

    # Class weights: in each round all tasks update from the common weights.  Pair counts go along.
    bits = _bits(total)
    features = _rows(bits)
    weights, by_pair = np.zeros((features, CLASSES), dtype=np.float32), np.zeros((max(head, 1), CLASSES))
    mass = np.bincount(classes, weights=numbers[:head], minlength=CLASSES) if head else np.zeros(CLASSES)
    mass[-1] += total - mass.sum() + 1
    weights[0] = np.log((mass + 1e-3) / (mass + 1e-3).sum())  # the bias begins at the classes' frequencies
    cut, per_slice = features * CLASSES + features, SLICE_BYTES // 4
    for k in range(ROUNDS if head else 0):
        now = shared((table.keys, table.slots, classes, weights))
        rate = 0.7 if k == 0 else 0.5 if k == 1 else 0.3

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            keys, slots, classes, start = now.value
            table = Lookup(keys, slots)
            mine, seen = start.copy(), np.zeros(features, dtype=np.float32)
            held = _Tally(head * CLASSES)
            wait: list = []
            size = 0
            for batch in batches:
                for *_, tokens, bounds in _tokens(batch.column("text")):
                    if not len(tokens):
                        continue
                    found = table.find(tokens)
                    kind = _classes_of(found, head, classes)
                    before = np.empty_like(kind)
                    before[1:] = kind[:-1]
                    before[bounds[:-1]] = 0
                    ok = (found >= 0) & (found < head)
                    held.add((found[ok].astype(np.int64) * CLASSES + before[ok]).astype(np.int32))
                    wait.append((*_features(*_history(tokens, bounds), bits), kind))
                    size += len(tokens)
                    if size >= BATCH:
                        parts = [np.concatenate(x) for x in zip(*wait, strict=True)]
                        for a in range(0, size - BATCH + 1, BATCH):
                            _update(mine, seen, [f[a : a + BATCH] for f in parts[:3]], parts[3][a : a + BATCH], rate)
                        rest = size - size % BATCH
                        wait, size = [tuple(x[rest:] for x in parts)], size % BATCH
            if size:
                parts = [np.concatenate(x) for x in zip(*wait, strict=True)]
                _update(mine, seen, list(parts[:3]), parts[3], rate)
            mine -= start
            mine *= seen[:, None]
            part = TaskContext.get().partitionId()
            yield slices_of(np.concatenate([mine.reshape(-1), seen, np.zeros(-cut % per_slice, dtype=np.float32)]), part)
            yield wide_slices_of(held.total(), part, -(-cut // per_slice))

        part = train.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k).select("text").coalesce(tasks)
        merged = merge_slices(part.mapInArrow(learn, slices), "mixed", -(-cut // per_slice))
        if len(merged):
            change, seen = merged[: features * CLASSES].reshape(features, CLASSES), merged[features * CLASSES : cut]
            weights = (weights + change / np.maximum(seen, 1.0)[:, None]).astype(np.float32)
            by_pair += merged[-(-cut // per_slice) * per_slice :].reshape(head, CLASSES)
    words = _word_level(by_pair, numbers[:head], classes).astype(np.float32) if head else np.zeros((1, CLASSES), dtype=np.float32)
    if not head:
        weights[0, :-1] = -1e9  # nothing but unknown words
    tail = math.log10(total - numbers[:head].sum() + distinct - head + 1)
    model = shared((keys, Lookup(keys).slots, numbers if len(numbers) else np.zeros(1), head, classes, bits, weights, words, tail, denominator))

    scored = df.mapInArrow(_score(model), f"id {df.schema['id'].dataType.simpleString()}, held boolean, n_tokens long, known long, base double, score double, rare array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
