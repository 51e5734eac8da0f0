"""Removal of long repeated strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

*Which suffixes.*  Of the first ``w`` positions of a string of that length, its *anchor* is the one whose next ``k`` bytes
have the least hash.  Equal strings have their anchors at equal offsets, so it is enough to sort the suffixes that
start at anchors, about 2 / w of all.  An anchor owns the neighbouring string starts that chose it, and carries as many
bytes to the left and to the right as these strings reach.  A first pass counts, by hash, the beginnings that
every string of an anchor holds; anchors whose beginning occurs once cannot match and are left out.

*Sort.*  A task sorts its suffixes, folds equal ones into one, and cuts the run at splitters that a sample of
beginnings gave.  Runs are sent front-coded: of each suffix the length of the prefix that it shares with the one before
and the rest.  The receiving task merges the runs with a loser tree whose players know how much they share with the
last winner: unequal lengths decide a match without a look at the strings, equal ones are compared from there on.

*Matches.*  The merged order comes with its shared prefix lengths.  Two suffixes hold the same string at offset o
of the anchor if they share length - o bytes to the right and o bytes to the left; both are classes of
sorted orders, so a level costs a pass over numbers and no pair is formed.

A beginning that more than ``HOT`` suffixes share could fill a task; its strings are counted one by one by 128-bit
fingerprints, an aggregation that combines before its shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize
from siltstone.llm.textkernel import mix
from siltstone.llm.token_counts import bit_map

#: Bytes of text whose anchors are found at once, and bytes of suffixes that a run holds.
PIECE_BYTES, RUN_BYTES = 1 << 21, 48 << 20
#: Bytes of suffixes that a merging task should receive, and suffixes whose matches are found at once.
PART_BYTES, LEVEL_ROWS = 32 << 20, 1 << 15
#: Suffixes with one beginning, above which its strings are counted by fingerprints.
HOT = 1 << 16
#: Strings that a task holds while it folds them by fingerprint, about 200 bytes each.
HELD_PRINTS = 1 << 19
#: Splitters come from about this many beginnings.
SAMPLE = 1 << 14
#: Tables of spans are broadcast up to this many bytes, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Geometry:
    """Sizes that follow from the length of the strings: window, hashed bytes, bytes that all strings of an anchor hold."""

    def __init__(self, length: int) -> None:
        if length < 1:
            raise ValueError("strings have a byte at least")
        self.length = length
        self.window = 1 << max(0, (length * 2 // 3).bit_length() - 1)
        self.least = length - self.window + 1
        self.gram = 1 << min(4, self.least.bit_length() - 1)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on (k a power of two); fewer positions than bytes by k - 1."""
    h, span = _BYTE[data], 1
    while span < k:
        h = h[: len(h) - span] * np.uint64(0xD6E8FEB86659FD93) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return h * np.uint64(0x94D049BB133111EB)


class Anchors:
    """Anchors of a piece of texts laid end to end: position, owned starts (first and last), hash of the beginning."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, g: Geometry, starts: int | None = None) -> None:
        """``ends``: where each text ends; only string starts before ``starts`` are looked at."""
        n = len(data)
        upto = min(n - g.length + 1, n if starts is None else starts)
        self.at = self.first = self.last = np.empty(0, dtype=np.int64)
        self.key = np.empty(0, dtype=np.uint64)
        if upto <= 0:
            return
        grams = _grams(data, g.gram)
        place = np.uint64(max(1, int(len(grams)).bit_length()))
        least = (grams >> place << place) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span < g.window:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        anchor = (least[:upto] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
        room = np.ones(upto, dtype=bool)
        for end in ends:
            room[max(0, end - g.length + 1) : end] = False
        begins = room.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | ~room[:-1]
        self.first = np.flatnonzero(begins)
        if not len(self.first):
            return
        stops = room.copy()
        stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~room[1:]
        self.last, self.at = np.flatnonzero(stops), anchor[self.first]
        key = grams[self.at + g.least - g.gram]
        for step in range(0, g.least - g.gram, g.gram):
            key = mix(key ^ (grams[self.at + step] + np.uint64(step)))
        self.key = key


def _pieces(batches: Iterator[pa.RecordBatch], g: Geometry) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, Anchors]]:
    """Bytes, text ends, digests of the texts, where each begins in its text's own count, and anchors, piece by piece."""

    def laid(texts: list[bytes], keys: list[bytes], shifts: list[int], starts: int | None):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        return data, ends, keys, np.asarray(shifts, dtype=np.int64), Anchors(data, ends, g, starts)

    texts, keys, held = [], [], 0
    for batch in batches:
        for text in batch.column("text"):
            text = memoryview(text.as_buffer())
            if len(text) < g.length:
                continue
            digest = hashlib.sha256(text).digest()[:16]
            if len(text) > PIECE_BYTES:
                # String starts of a long text are dealt to pieces; a piece reaches on to the end of its last string.
                for at in range(0, len(text) - g.length + 1, PIECE_BYTES):
                    yield laid([bytes(text[at : at + PIECE_BYTES + g.length - 1])], [digest], [at], PIECE_BYTES)
                continue
            texts.append(bytes(text))
            keys.append(digest)
            held += len(text)
            if held >= PIECE_BYTES:
                yield laid(texts, keys, [0] * len(texts), None)
                texts, keys, held = [], [], 0
    if texts:
        yield laid(texts, keys, [0] * len(texts), None)


def shared_from(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``at`` bytes are known to be common."""
    most = min(len(a), len(b))
    while at < most and a[at : at + 64] == b[at : at + 64]:
        at += 64
    for step in (32, 16, 8, 4, 2, 1):
        if at < most and a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, most)


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of ascending keys: shared prefix with the one before, length of the rest, and the rests."""
    shared = np.zeros(len(keys), dtype=np.uint32)
    for k in range(1, len(keys)):
        shared[k] = shared_from(keys[k - 1], keys[k], 0)
    rests = [key[s:] for key, s in zip(keys, shared.tolist(), strict=True)]
    return shared, np.array([len(r) for r in rests], dtype=np.uint32), b"".join(rests)


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared prefix with the one before, key), one at a time."""
    key, at = b"", 0
    for s, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        key = key[:s] + rests[at : at + n]
        at += n
        yield s, key


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, shared prefix with the winner before, key) of ascending runs, in order, by a loser tree.

    A player is [shared with the last winner, key, run].  In a match the one that shares more is the smaller one; only
    if both share the same length are the keys compared, from there on, and the loser keeps what it shares with the
    winner of the match.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    tree: list[list | None] = [None] * size

    def play(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        """(winner, loser); None, a run at its end, loses."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y, at = a[1], b[1], a[0]
        common = shared_from(x, y, at)
        if x[common : common + 1] <= y[common : common + 1]:
            b[0] = common
            return a, b
        a[0] = common
        return b, a

    def next_of(run: int) -> list | None:
        got = next(runs[run], None) if run < len(runs) else None
        return None if got is None else [got[0], got[1], run]

    def first(node: int) -> list | None:
        if node >= size:
            return next_of(node - size)
        winner, tree[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    # At first nothing is shared with any winner: every run begins with a key that shares 0.
    winner = first(1) if size > 1 else next_of(0)
    while winner is not None:
        shared, key, run = winner
        yield run, shared, key
        # What the next key of the same run shares with this winner is what its run says.
        winner, node = next_of(run), (size + run) // 2
        while node >= 1 and size > 1:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def matched(shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, many: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset at which a suffix's string occurs twice, -1 if at none.

    ``shared``: prefix shared with the suffix before; ``lefts``: bytes before the anchor, backwards; ``low`` and ``high``:
    least and greatest offset that the anchor owns; ``many``: the suffix stands for several equal ones.
    """
    m = len(lefts)
    order = sorted(range(m), key=lefts.__getitem__)
    left_shared = np.zeros(m, dtype=np.int64)
    for k in range(1, m):
        left_shared[k] = shared_from(lefts[order[k - 1]], lefts[order[k]], 0)
    order = np.asarray(order, dtype=np.int64)
    least, greatest = np.full(m, -1, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    left_class = np.empty(m, dtype=np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) == 0:
            continue
        left_class[order] = np.cumsum(left_shared < o)
        key = np.cumsum(shared < g.length - o)[own] * np.int64(m + 1) + left_class[own]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        several = np.add.reduceat(np.where(many[own[by]], 2, 1), np.flatnonzero(new)) > 1
        found = own[by[several[group]]]
        greatest[found] = o
        least[found[least[found] < 0]] = o
    return least, greatest


def _runs_of(entries: list[tuple], splitters: list[bytes], run: int, g: Geometry) -> Iterator[tuple]:
    """Rows (part, run, data, digest, first, last) of a task's suffixes: runs by part, and strings known to repeat.

    An entry is (right, left backwards, low, digest, at).  Equal suffixes with equal owned offsets hold equal strings.
    """
    entries.sort(key=lambda e: e[:3])
    kept: list[tuple] = []
    k = 0
    while k < len(entries):
        stop = k + 1
        while stop < len(entries) and entries[stop][:3] == entries[k][:3]:
            stop += 1
        if stop > k + 1:
            for right, left, low, digest, at in dict.fromkeys(entries[k:stop]):
                yield None, None, None, digest, at - len(left), at - low + g.length
        kept.append((*entries[k], stop > k + 1))
        k = stop
    cuts = [0]
    for splitter in splitters:
        low, high = cuts[-1], len(kept)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if kept[middle][0][: g.least] < splitter else (low, middle)
        cuts.append(low)
    for part, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(kept)], strict=True)):
        some = kept[low:high]
        if not some:
            continue
        shared, lengths, rests = front_coded([e[0] for e in some])
        numbers = np.array([[e[2], len(e[1]), e[4], e[5]] for e in some], dtype=np.int64)
        yield part, run, b"".join([
            np.array([len(some)], dtype=np.uint32).tobytes(), shared.tobytes(), lengths.tobytes(), numbers.tobytes(),
            b"".join(e[3] for e in some), b"".join(e[1] for e in some), rests,
        ]), None, None, None


class _Run:
    """A run as it was sent; keys are decoded one at a time, in step with the merge."""

    def __init__(self, data: bytes) -> None:
        m = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
        at = 4
        self.shared, self.lengths = (np.frombuffer(data, dtype=np.uint32, count=m, offset=at + 4 * m * k) for k in range(2))
        at += 8 * m
        self.numbers = np.frombuffer(data, dtype=np.int64, count=4 * m, offset=at).reshape(m, 4)
        at += 32 * m
        self.digests, at = data[at : at + 16 * m], at + 16 * m
        self.left_ends = np.cumsum(self.numbers[:, 1])
        size = int(self.left_ends[-1])
        self.lefts, self.rests, self.taken = data[at : at + size], data[at + size :], 0

    def keys(self) -> Iterator[tuple[int, bytes]]:
        return decoded(self.shared, self.lengths, self.rests)

    def take(self) -> tuple[bytes, int, int, int, bytes]:
        """Left bytes, low, anchor, several, digest of the key that came last."""
        k, self.taken = self.taken, self.taken + 1
        low, n, at, several = self.numbers[k].tolist()
        end = int(self.left_ends[k])
        return self.lefts[end - n : end], low, at, several, self.digests[16 * k : 16 * k + 16]


def _resolve(blobs: list[bytes], g: Geometry) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that occur twice among the runs of one part."""
    runs = [_Run(b) for b in blobs]
    shared: list[int] = []
    held: list[tuple] = []

    def spans() -> pa.RecordBatch | None:
        low = np.array([h[1] for h in held], dtype=np.int64)
        high = np.array([len(h[0]) for h in held], dtype=np.int64)
        many = np.array([h[3] for h in held], dtype=bool)
        least, greatest = matched(np.array(shared, dtype=np.int64), [h[0] for h in held], low, high, many, g)
        rows = {(held[k][4], held[k][2] - int(greatest[k]), held[k][2] - int(least[k]) + g.length) for k in np.flatnonzero(least >= 0)}
        digests, firsts, lasts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())], names=["digest", "first", "last"])

    for run, common, _ in merged([r.keys() for r in runs]):
        # Suffixes that differ within the beginning have no string in common: what is held can be settled there.
        if common < g.least and len(held) >= LEVEL_ROWS:
            yield spans()
            shared, held = [], []
        shared.append(common if held else 0)
        held.append(runs[run].take())
    if held:
        yield spans()


def _beginnings(texts: DataFrame, g: Geometry) -> DataFrame:
    """(key, n, sample): how many anchors have each beginning; of some keys also the beginning itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, _, _, _, anchors in _pieces(batches, g):
            keys, where, n = np.unique(anchors.key, return_index=True, return_counts=True)
            some = [data[a : a + g.least].tobytes() if k % 64 == 0 else None for k, a in zip(keys.tolist(), anchors.at[where].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64()), pa.array(some, pa.binary())], names=["key", "n", "sample"])

    rows = texts.mapInArrow(count, "key long, n long, sample binary")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("sample").alias("sample")).where("n > 1")


def _bits(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    size = 1 << min(29, max(16, math.ceil(math.log2(16 * n + 1))))
    return bit_map(keys.select(F.expr(f"pmod(key, {size})").alias("slot")), size), size


def _marked(bits: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    table, size = bits
    slot = keys & np.uint64(size - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated_spans(texts: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(digest, spans): of each text with repeated strings, known by half a SHA-256, the maximal runs of bytes covered."""
    spark, g = texts.sparkSession, Geometry(length)
    counted = materialize(_beginnings(texts, g), "beginnings")
    n_keys, n_rows, n_hot, n_some = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > hot), F.count("sample")).first()
    schema = "digest binary, first long, last long"
    if not n_keys:
        return spark.createDataFrame([], "digest binary, spans array<struct<first:bigint,last:bigint>>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows * (length + g.window) / PART_BYTES))
    # A sample of bounded size, chosen by hash: keys are hashes, and the sample thins out as they grow in number.
    thin = max(1, n_some // SAMPLE)
    some = sorted(bytes(r[0]) for r in counted.where(f"sample is not null and pmod(xxhash64(key), {thin}) = 0").select("sample").collect())
    splitters = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    repeats = spark.sparkContext.broadcast(_bits(counted, n_keys))
    hots = spark.sparkContext.broadcast(_bits(counted.where(F.col("n") > hot), n_hot) if n_hot else None)
    given = spark.sparkContext.broadcast(splitters)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held, n_runs = [], 0, 0
        names = ["part", "run", "data", "digest", "first", "last"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            size = 0
            for row in _runs_of(entries, given.value, (TaskContext.get().partitionId() << 20) + n_runs, g):
                rows.append(row)
                size += 40 + len(row[2] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for data, ends, digests, shifts, anchors in _pieces(batches, g):
            take = _marked(repeats.value, anchors.key)
            if hots.value is not None:
                take &= ~_marked(hots.value, anchors.key)
            raw, at, first, last = data.tobytes(), anchors.at[take], anchors.first[take], anchors.last[take]
            which = np.searchsorted(ends, at, side="right")
            begins = np.r_[0, ends[:-1]][which] - shifts[which]
            for a, p, q, text, begin in zip(at.tolist(), first.tolist(), last.tolist(), which.tolist(), begins.tolist(), strict=True):
                entries.append((raw[a : q + length], raw[p:a][::-1], a - q, digests[text], a - begin))
                held += q + length - p + 200
            if held > RUN_BYTES:
                yield from flush()
                entries, held, n_runs = [], 0, n_runs + 1
        if entries:
            yield from flush()

    sent = texts.mapInArrow(sort, "part int, run long, data binary, " + schema)
    # Spans that a task found by itself pass through any task.
    sent = sent.withColumn("part", F.coalesce("part", F.expr(f"cast(pmod(hash(digest, first), {parts}) as int)"))).repartitionById(parts, "part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            plain = batch.filter(batch.column("digest").is_valid())
            if plain.num_rows:
                yield plain.select(["digest", "first", "last"])
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if data.is_valid:
                    blobs.setdefault(part, []).append(data.as_py())
        while blobs:
            yield from _resolve(blobs.popitem()[1], g)

    found = sent.mapInArrow(merge, schema)
    if n_hot:
        found = found.unionByName(_counted_one_by_one(texts, hots, g))
    joined = found.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("some"))
    return joined.select("digest", united(F.col("some")).alias("spans"))


def _counted_one_by_one(texts: DataFrame, hots, g: Geometry) -> DataFrame:
    """(digest, first, last) of repeated strings whose anchors have a hot beginning, by fingerprints of each string."""

    names, kinds = ["print", "digest", "first", "n"], [pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def folded(held: dict[bytes, list[tuple[bytes, int]]]) -> pa.RecordBatch:
        """A row for each string; strings that occur twice here are known to repeat, so their places need no join."""
        rows = []
        for print_, places in held.items():
            if len(places) == 1:
                rows.append((print_, *places[0], 1))
            else:
                rows.append((print_, None, None, len(places)))
                rows += [(None, *place, len(places)) for place in set(places)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[bytes, int]]] = {}
        n = 0
        for data, ends, digests, shifts, anchors in _pieces(batches, g):
            take = _marked(hots.value, anchors.key)
            raw, first, last = data.tobytes(), anchors.first[take], anchors.last[take]
            which = np.searchsorted(ends, first, side="right")
            begins = np.r_[0, ends[:-1]][which] - shifts[which]
            for a, b, text, begin in zip(first.tolist(), last.tolist(), which.tolist(), begins.tolist(), strict=True):
                n += b + 1 - a
                for p in range(a, b + 1):
                    held.setdefault(hashlib.blake2b(raw[p : p + g.length], digest_size=16).digest(), []).append((digests[text], p - begin))
            if n > HELD_PRINTS:
                yield folded(held)
                held, n = {}, 0
        if held:
            yield folded(held)

    rows = materialize(texts.mapInArrow(prints, "print binary, digest binary, first long, n long"), "prints")
    # Of a string there is at most a row for each time a task folded, whatever the number of its places.
    single = rows.where("print is not null and digest is not null")
    twice = rows.where("print is not null").groupBy("print").agg(F.sum("n").alias("n")).where("n > 1").select("print")
    found = rows.where("print is null").unionByName(single.join(twice, "print", "left_semi").select(rows.columns))
    return found.select("digest", "first", (F.col("first") + g.length).alias("last"))


def united(spans: Column) -> Column:
    """Maximal runs of sorted spans; spans that touch are one run."""
    start = F.struct(F.array().cast("array<struct<first:bigint,last:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))

    def more(got: Column, s: Column) -> Column:
        on = F.struct(got["done"].alias("done"), got["first"].alias("first"), F.greatest(got["last"], s["last"]).alias("last"))
        done = F.when(got["first"].isNull(), got["done"]).otherwise(F.concat(got["done"], F.array(F.struct(got["first"].alias("first"), got["last"].alias("last")))))
        return F.when(s["first"] <= got["last"], on).otherwise(F.struct(done.alias("done"), s["first"].alias("first"), s["last"].alias("last")))

    return F.aggregate(spans, start, more, lambda got: F.concat(got["done"], F.array(F.struct(got["first"].alias("first"), got["last"].alias("last")))))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, spans (first and last byte + 1 of each removed run), kept (bytes).

    Texts are UTF-8 bytes, whole, of any length; null is the empty text.  Strings are judged on the input: all their
    occurrences go, none is spared, and repeated rows of ``length`` bytes or more go whole.  Rows may repeat ids or have
    none, as a row's text alone decides.  Cuts may fall inside a character, so what is kept is binary.  Texts
    shorter than ``length`` stay as they are.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    spans = materialize(repeated_spans(rows.select("text"), length, hot), "spans")
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 16 + 40), F.lit(0))).first()[0]
    keyed = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    keyed = keyed.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "digest", "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, some in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                text = memoryview(text.as_buffer())
                at, kept = 0, []
                for span in some or []:
                    kept.append(text[at : span["first"]])
                    at = span["last"]
                out.append(b"".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t.as_buffer()) for t in batch.column("text")], pa.int64()), batch.column("spans"), pa.array(out, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    done = keyed.mapInArrow(cut, f"id {keyed.schema['id'].dataType.simpleString()}, n_bytes long, spans {keyed.schema['spans'].dataType.simpleString()}, kept binary")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return done.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.coalesce("spans", none).alias("spans"), "kept")
