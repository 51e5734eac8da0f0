"""Approximate nearest neighbours by a permutation index.

A few *pivots* are drawn from the vectors.  A vector is represented by its nearest pivots in order and posted, with
that order, in the inverted files of its ``POSTED`` nearest.  A query reads the files of its own nearest pivots, ranks what
it meets there by the footrule distance of the two orders (the sum of differences of pivot positions, an absent pivot
standing behind all present ones), and only candidates within the calibrated footrule radius are reranked by the exact
inner product in double precision.

The pivot is the key by which files are dealt to tasks: a query is sent to the files it reads and to no other.  A file
longer than a block is cut by a hash, and so are the queries of a file, so no task holds more than a block however
common a pivot is.  A vector that a query meets in several files counts in the first of them only.

Largest inner product is turned into nearness by one more coordinate that gives all vectors the same norm.  How many
files are read and the radius are calibrated on a bounded sample of the *queries*, whose true answers one pass over all
entries finds.  Queries near to a pivot and queries far from all of them differ, so bands by that nearness are
calibrated apart.  After the search the sampled queries' answers are compared with the true ones; a band that
missed more than it may reads all files without a radius, and so does a query that found fewer than k others.
All vectors are indexed and all queries run.  Equal vectors are one entry: only their k + 1 smallest ids can be answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from siltstone.llm.common import lists_of, materialize, whole_groups

#: Files a vector is posted in, and pivots of an order that the footrule distance looks at.
POSTED, ORDER = 4, 32
#: Fewest and most pivots; between them they grow with the square root of the vectors.
LEAST_PIVOTS, MOST_PIVOTS = 64, 1 << 14
#: Vectors and queries of a unit; vectors and queries drawn for calibration, and vectors that pairs are timed with.
BLOCK, QUERY_BLOCK, SAMPLE, SAMPLE_QUERIES, SAMPLE_PAIRS = 8192, 2048, 4096, 256, 1024
#: Most queries of a unit that are ranked at once.
AT_ONCE = 128
#: Bands of queries that are calibrated apart, and sampled queries that a band should have.
BANDS, BAND_QUERIES = 4, 48
#: But for FEW of the queries of a band, each finds LEAST_RECALL; MARGIN of what may be missed is kept back.
FEW, LEAST_RECALL, MARGIN = 0.05, 0.9, 0.4
_UNIT = ["pivot", "part", "query_part"]


def _orders(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector, nearest first, ties to the earlier one."""
    out, step = [], max(1, (1 << 22) // len(pivots))
    for a in range(0, len(vectors), step):
        near = -(vectors[a : a + step] @ pivots.T + extra[a : a + step, None] * pivot_extra[None, :])
        out.append(np.argsort(near, axis=1, kind="stable")[:, :length].astype(np.int16))
    return np.concatenate(out)


def _closeness(queries: np.ndarray, orders: np.ndarray, n_pivots: int, length: int) -> np.ndarray:
    """What shared pivots take off the largest footrule distance, for all pairs of query orders and orders."""
    length = min(length, queries.shape[1], orders.shape[1])
    gain = np.zeros((len(queries), n_pivots, length), dtype=np.int16)
    places = np.arange(length)
    for j in range(length):
        gain[np.arange(len(queries)), queries[:, j], :] = length + 1 - np.abs(places - j)
    gain = gain.reshape(len(queries), -1)
    out = np.zeros((len(queries), len(orders)), dtype=np.int16)
    for j in range(length):
        out += gain[:, orders[:, j].astype(np.int64) * length + j]
    return out


def _met(queries: np.ndarray, orders: np.ndarray, n_pivots: int, probes: int) -> np.ndarray:
    """Place, in each query's order, of the first file in which it meets each vector; ``probes`` if in none."""
    place = np.full((len(queries), n_pivots), probes, dtype=np.int16)
    read = min(probes, queries.shape[1])
    place[np.arange(len(queries))[:, None], queries[:, :read]] = np.arange(read, dtype=np.int16)
    out = place[:, orders[:, 0]]
    for j in range(1, min(POSTED, orders.shape[1])):
        out = np.minimum(out, place[:, orders[:, j]])
    return out


def _found_at(ranks: np.ndarray, orders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of answers (query, answer, place): the place of the first file in which the query meets it, and the closeness.

    ``ranks``: the place of each pivot in each query's order.
    """
    pivots = orders.astype(np.int64)
    places = np.take_along_axis(ranks[:, None, :].repeat(pivots.shape[1], axis=1), pivots, axis=2)
    gain = np.where(places < length, length + 1 - np.abs(places - np.arange(places.shape[2])), 0)
    return places[:, :, :POSTED].min(axis=2), gain[:, :, :length].sum(axis=2)


def calibrated(place: np.ndarray, close: np.ndarray, true: np.ndarray, met: np.ndarray, sample_close: np.ndarray, n_pivots: int, recall: float) -> tuple[int, int, float, float]:
    """(files to read, least closeness, share of pairs met, share scored): the least work that finds enough answers.

    ``place``, ``close`` of the answers ``true`` (query, answer); ``met``, ``sample_close`` of pairs of the same queries and
    of sampled entries.  Enough: ``recall`` on average and, but for ``FEW`` of the queries, ``LEAST_RECALL`` for each.
    """
    count = np.maximum(true.sum(axis=1), 1)

    def enough(probes: int, radius: int) -> bool:
        got = np.where(true.any(axis=1), ((place < probes) & (close >= radius) & true).sum(axis=1) / count, 1.0)
        return got.mean() >= recall + (1 - recall) * MARGIN and (got < LEAST_RECALL).mean() <= FEW * (1 - MARGIN)

    choices, levels = [], np.unique(close[true])
    for probes in sorted({min(p, n_pivots) for p in (*(2**e for e in range(16)), *(3 * 2**e for e in range(15)), n_pivots)}):
        if not enough(probes, 0):
            continue
        low, high = 0, len(levels)  # levels[:low] are enough
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if enough(probes, int(levels[middle])) else (low, middle)
        radius = int(levels[low - 1]) if low else 0
        read = met < probes
        scored = float((read & (sample_close >= radius)).mean())
        # A pair met costs ORDER look-ups, a pair scored a row of a product.
        choices.append((2 * float(read.mean()) + scored, probes, radius, float(read.mean()), scored))
    return min(choices)[1:] if choices else (n_pivots, 0, 1.0, 1.0)


def _usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _with_orders(df: DataFrame, shared, is_query: bool, length: int, schema: str) -> DataFrame:
    """``df`` (…, v) with ``ord``, the ``length`` nearest pivots of v, and ``near``, the cosine to the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, pivot_extra, largest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, _ = lists_of(batch.column("v"))
            x = flat.reshape(batch.num_rows, -1).astype(np.float64)
            norms = (x**2).sum(axis=1)
            extra = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(largest - norms, 0.0))
            orders = _orders(x, extra, pivots, pivot_extra, length)
            near = ((x * pivots[orders[:, 0]]).sum(axis=1) + extra * pivot_extra[orders[:, 0]]) / np.sqrt((norms + extra**2) * largest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, orders.size + 1, orders.shape[1]).astype(np.int32)), pa.array(orders.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near)], names=[*batch.schema.names, "ord", "near"])

    return df.mapInArrow(run, f"{schema}, ord array<short>, near double")


def _true_answers(entries: DataFrame, numbers: np.ndarray, own: list[str], vectors: np.ndarray, k: int) -> DataFrame:
    """(number, no, score, ord): the k best entries, other than its own, of each query of a bounded sample."""
    shared = entries.sparkSession.sparkContext.broadcast((numbers, np.array(own), vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, vectors = shared.value
        held = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.int16))] * len(numbers)
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                flat, _ = lists_of(part.column("v"))
                orders, starts = lists_of(part.column("ord"))
                orders, no = orders.reshape(part.num_rows, -1), part.column("no").to_numpy()
                scores = vectors @ flat.reshape(part.num_rows, -1).astype(np.float64).T
                scores[own[:, None] == np.array(part.column("same").to_pylist())[None, :]] = -np.inf
                for q in range(len(numbers)):
                    best = np.argsort(-scores[q], kind="stable")[:k] if len(scores[q]) <= k else np.argpartition(-scores[q], k - 1)[:k]
                    best = best[scores[q, best] > -np.inf]
                    s, n, o = (np.concatenate([x, y]) if len(x) else y for x, y in zip(held[q], (scores[q, best], no[best], orders[best]), strict=True))
                    top = np.lexsort((n, -s))[:k]
                    held[q] = (s[top], n[top], o[top])
        some = [(number, *h) for number, h in zip(numbers.tolist(), held, strict=True) if len(h[0])]
        if some:
            s, n, o = (np.concatenate([x[c] for x in some]) for c in (1, 2, 3))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, o.size + 1, o.shape[1]).astype(np.int32)), pa.array(o.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], [len(x[1]) for x in some])), pa.array(n), pa.array(s), lists], names=["number", "no", "score", "ord"])

    best = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "no"))
    found = entries.select("no", "same", "v", "ord").mapInArrow(scan, "number long, no long, score double, ord array<short>")
    return found.withColumn("place", best).where(F.col("place") <= k).drop("place")


def _search(entries: DataFrame, asked: DataFrame, n_pivots: int, bands: list[tuple[int, int]], k: int) -> DataFrame:
    """(number, no, score): the k + 1 best entries, and those that tie with the last, of each query and unit.

    ``bands``: files to read and least closeness of the queries of each band.
    """
    files = entries.select("no", "v", "ord", F.explode(F.slice("ord", 1, POSTED)).alias("pivot"))
    probes = F.element_at(F.array(*(F.lit(p) for p, _ in bands)), F.col("band") + 1)
    reads = asked.select("number", "v", F.slice("ord", F.lit(1), F.greatest(probes, F.lit(ORDER))).alias("ord"), "band", F.explode(F.slice("ord", F.lit(1), probes)).alias("pivot"))
    # One row for each pivot: how many blocks its file and its queries are cut into.
    sizes = files.groupBy("pivot").agg(F.count("*").alias("rows")).join(reads.groupBy("pivot").agg(F.count("*").alias("queries")), "pivot")
    sizes = F.broadcast(sizes.select("pivot", F.ceil(F.col("rows") / BLOCK).alias("parts"), F.ceil(F.col("queries") / QUERY_BLOCK).alias("query_parts")))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1L)"))
    units = (
        files.join(sizes, "pivot").select("pivot", F.expr("pmod(xxhash64(no), parts)").alias("part"), every("query_parts").alias("query_part"), F.lit(-1).alias("band"), F.col("no").alias("name"), "v", "ord")
        .unionByName(reads.join(sizes, "pivot").select("pivot", every("parts").alias("part"), F.expr("pmod(xxhash64(number), query_parts)").alias("query_part"), "band", F.col("number").alias("name"), "v", "ord"))
    )
    at_once = max(1, min(AT_ONCE, (1 << 19) // n_pivots))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, _UNIT):
            vectors, bounds = lists_of(table.column("v"))
            vectors, band = vectors.reshape(table.num_rows, -1), table.column("band").to_numpy()
            orders, starts = lists_of(table.column("ord"))
            names, pivot = table.column("name").to_numpy(), table.column("pivot").to_numpy()

            def rows_of(rows: np.ndarray, orders: np.ndarray = orders, starts: np.ndarray = starts) -> np.ndarray:
                return orders[starts[rows][:, None] + np.arange(starts[rows[0] + 1] - starts[rows[0]])]

            for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
                here = a + np.flatnonzero(band[a:b] < 0)
                if not len(here) or len(here) == b - a:
                    continue
                own = rows_of(here)
                out_query, out_entry, out_score = [], [], []
                for which, (probes, radius) in enumerate(bands):
                    ask = a + np.flatnonzero(band[a:b] == which)
                    for c in range(0, len(ask), at_once):
                        some = ask[c : c + at_once]
                        theirs = rows_of(some)
                        place = np.argmax(theirs == pivot[a], axis=1).astype(np.int16)
                        mine = _met(theirs, own, n_pivots, probes) == place[:, None]
                        if radius > 0:
                            mine &= _closeness(theirs[:, :ORDER], own, n_pivots, ORDER) >= radius
                        for i, row in enumerate(some.tolist()):
                            near = here[np.flatnonzero(mine[i])]
                            if not len(near):
                                continue
                            s = vectors[near].astype(np.float64) @ vectors[row].astype(np.float64)
                            if len(s) > k + 1:
                                best = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                                near, s = near[best], s[best]
                            out_query.append(np.full(len(near), names[row]))
                            out_entry.append(names[near])
                            out_score.append(s)
                if out_query:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_query, out_entry, out_score)], names=["number", "no", "score"])

    found = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(search, "number long, no long, score double")
    best = F.rank().over(Window.partitionBy("number").orderBy(F.desc("score")))
    return found.withColumn("place", best).where(F.col("place") <= k + 1).drop("place")


class _Plan:
    """Bands of the queries, calibrated on a sample of them against their true answers over all entries."""

    def __init__(self, entries: DataFrame, wanted: DataFrame, sample: np.ndarray, sample_orders: np.ndarray, n_pivots: int, k: int, recall: float) -> None:
        drawn = wanted.select("number", "same", "v", "ord", "near").orderBy(F.xxhash64("same", "number", F.lit(11))).limit(SAMPLE_QUERIES).toArrow()
        self.cuts, self.bands, self.work, self.last = [], [(n_pivots, 0)], [], {}
        if not drawn.num_rows:
            return
        numbers, near = drawn.column("number").to_numpy(), drawn.column("near").to_numpy()
        vectors = lists_of(drawn.column("v"))[0].reshape(len(numbers), -1).astype(np.float64)
        orders = lists_of(drawn.column("ord"))[0].reshape(len(numbers), -1)
        ranks = np.empty((len(numbers), n_pivots), dtype=np.int16)
        np.put_along_axis(ranks, orders.astype(np.int64), np.arange(n_pivots, dtype=np.int16)[None, :], axis=1)
        rows = _true_answers(entries, numbers, drawn.column("same").to_pylist(), vectors, k).toArrow()  # k rows a sampled query
        row_of = {n: i for i, n in enumerate(numbers.tolist())}
        true = np.zeros((len(numbers), k), dtype=bool)
        answers = np.zeros((len(numbers), k, sample_orders.shape[1]), dtype=np.int16)
        for number, score, order in zip(rows.column("number").to_pylist(), rows.column("score").to_pylist(), rows.column("ord").to_pylist(), strict=True):
            q = row_of[number]
            at = int(true[q].sum())
            true[q, at], answers[q, at] = True, order
            low, n = self.last.get(number, (math.inf, 0))
            self.last[number] = (min(low, score), n + 1)
        place, close = _found_at(ranks, answers, ORDER)
        met, sample_close = _met(orders, sample_orders, n_pivots, n_pivots), _closeness(orders, sample_orders, n_pivots, ORDER)
        n_bands = max(1, min(BANDS, len(numbers) // BAND_QUERIES))
        self.cuts = [float(np.quantile(near, b / n_bands)) for b in range(1, n_bands)]
        band = np.searchsorted(self.cuts, near, side="right")
        self.bands = []
        for b in range(n_bands):
            of = band == b
            self.work.append(calibrated(*(x[of] for x in (place, close, true, met, sample_close)), n_pivots, recall) if of.any() else (n_pivots, 0, 1.0, 1.0))
            self.bands.append(self.work[-1][:2])
        self.band_of = dict(zip(numbers.tolist(), band.tolist(), strict=True))

    def band(self) -> Column:
        """The band of a query by its nearness to its first pivot."""
        band = F.lit(0)
        for cut in self.cuts:
            band = band + F.when(F.col("near") >= cut, 1).otherwise(0)
        return band

    def recalls(self, found: DataFrame) -> dict[int, float]:
        """Recall of each sampled query: how many of its true answers, or ties of the last, were found."""
        if not self.last:
            return {}
        spark = found.sparkSession
        asked = F.broadcast(spark.createDataFrame([(n, low) for n, (low, _) in self.last.items()], "number long, low double"))
        # A last score that another summing order changes in its last bits is the same score.
        near = F.col("score") >= F.col("low") - F.abs("low") * 1e-12
        got = {r["number"]: r["n"] for r in found.join(asked, "number").where(near).groupBy("number").agg(F.count("*").alias("n")).collect()}
        return {n: min(1.0, got.get(n, 0) / count) for n, (_, count) in self.last.items()}

    def failed(self, recalls: dict[int, float], recall: float) -> list[int]:
        """Bands whose sampled queries found less than they should."""
        by: dict[int, list[float]] = {}
        for number, r in recalls.items():
            by.setdefault(self.band_of[number], []).append(r)
        return [b for b, r in by.items() if sum(r) < recall * len(r) or sum(x < LEAST_RECALL for x in r) > FEW * len(r)]


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95) -> DataFrame:
    """(query_id, rank, ``id_col``, score, recall): for each row that ``queries`` marks, its k nearest other rows.

    Nearest is the largest inner product of the original vectors, in double precision; equal scores rank by smaller
    id, and ranks start at 1.  Fewer candidates than k give fewer rows.  Vectors that are null, empty, zero or hold
    a null or non-finite component take no part, nor do those whose length is not the most common one, nor rows
    with a null id.  Of rows that repeat an id, the one with the smallest digest counts.  Other columns are not read.

    ``recall`` is wanted on average over the queries, and 0.9 for each but one in twenty; both are held on the sample of at
    most ``SAMPLE_QUERIES`` queries, by bands, with a margin.  The column ``recall`` has what a sampled query found of its
    true answers, and null for other queries.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    element = df.schema[vector_col].dataType.elementType
    width = "float" if isinstance(element, (t.FloatType, t.ByteType, t.ShortType)) else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull())
    rows = rows.where(_usable(F.col("v")))
    # Adding 0.0 makes -0.0 equal to 0.0; equal vectors then have equal digests.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("same", F.sha2(F.array_join("v", ",").cast("binary"), 256))
    rows = rows.groupBy("id").agg(F.min_by(F.struct("v", "same", "asked"), "same").alias("r")).select("id", "r.*")
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double, recall double")
    rows = rows.where(F.size("v") == sizes[0]["d"])
    first = Window.partitionBy("same").orderBy("id")
    members = materialize(rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).select("same", "id", "v", "at"), "members")
    entries = members.where("at = 1").select(F.monotonically_increasing_id().alias("no"), "same", F.col("v").cast(f"array<{width}>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, largest = entries.agg(F.count("*"), F.max(norm)).first()

    n_pivots = min(max(LEAST_PIVOTS, 1 << math.ceil(math.log2(max(1.0, math.sqrt(total) / 2)))), MOST_PIVOTS)
    drawn = entries.select("v").orderBy(F.xxhash64("same", F.lit(7))).limit(max(SAMPLE, n_pivots)).toArrow().column("v").combine_chunks()
    flat, bounds = lists_of(drawn)
    sample = flat.reshape(len(bounds) - 1, -1).astype(np.float64)
    extra = np.sqrt(np.maximum(largest - (sample**2).sum(axis=1), 0.0))
    n_pivots = min(n_pivots, len(sample))
    pivots, pivot_extra = sample[:n_pivots], extra[:n_pivots]
    shared = spark.sparkContext.broadcast((pivots, pivot_extra, float(largest)))

    entries = materialize(_with_orders(entries, shared, False, ORDER, f"no long, same string, v array<{width}>"), "entries")
    wanted = rows.where("asked").select(F.monotonically_increasing_id().alias("number"), F.col("id").alias("query_id"), "same", F.col("v").cast(f"array<{width}>").alias("v"))
    wanted = materialize(_with_orders(wanted, shared, True, n_pivots, f"number long, query_id {kind}, same string, v array<{width}>"), "queries")
    timed = slice(max(0, len(sample) - SAMPLE_PAIRS), None)
    plan = _Plan(entries, wanted, sample[timed], _orders(sample[timed], extra[timed], pivots, pivot_extra, ORDER), n_pivots, k, recall)
    wanted = wanted.withColumn("band", plan.band())
    found = materialize(_search(entries, wanted, n_pivots, plan.bands, k), "found")
    # The exact way for queries that met fewer than k others, and for bands that found too little: all files, no radius.
    failed = plan.failed(plan.recalls(found), recall)
    enough = found.groupBy("number").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, total))
    short = wanted.join(enough, "number", "left_anti")
    short = materialize((wanted.where(F.col("band").isin(failed)).unionByName(short.where(~F.col("band").isin(failed))) if failed else short).withColumn("band", F.lit(0)), "short")
    if not short.isEmpty():
        exact = _search(entries, short, n_pivots, [(n_pivots, 0)], k)
        found = materialize(found.join(short.select("number"), "number", "left_anti").unionByName(exact), "found")
    measured = [(n, float(r)) for n, r in plan.recalls(found).items()]
    measured = F.broadcast(spark.createDataFrame(measured, "number long, recall double"))

    answers = found.join(entries.select("no", "same"), "no").join(members.select("same", F.col("id").alias("answer")), "same")
    answers = answers.join(wanted.select("number", "query_id"), "number").where("answer <> query_id").join(measured, "number", "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "answer"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("answer").alias(id_col), "score", "recall")
