"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their distinct word shingles reaches ``threshold``.

*Order.*  A fixed-size counting sketch over all shingles of all texts gives every shingle an estimated
frequency; shingles are ordered by it, ties by digest, so that each set has its rarest shingles first.

*Prefixes.*  With ``o = ceil(t * n)`` a partner of a set of ``n`` shingles shares at least ``o`` of them, so
the first ``n - o + l`` shingles of both hold at least ``l`` common ones, for every ``l <= o``.  All sets post
the prefix for the largest ``l``; a posting's *label* is the smallest ``l`` whose prefix contains it.  Postings
of shingles that only one set has fall away, and so do those beyond the ``l``-th that the very same sets share.  From
the true lengths of the remaining lists each set estimates, for every ``l``, the postings to scan plus the candidates
to verify and takes the cheapest ``l``.  A pair is compared with the smaller ``l`` of the two.

*Pairs.*  Pairs are never rows.  Sets that post a shingle meet in one unit; longer lists are cut into blocks by
size band and digest, and each pair of blocks is a unit of bounded bytes.  A pair is verified in exactly one
unit: that of its ``l``-th common prefix shingle.  A first pass over the prefixes finds the sets that
have such a pair in a unit; only for these are the texts read again and whole sets sent.  A unit returns a
spanning forest of its links and each set's number of links, so its output is linear in its rows.

Equal sets are one class throughout; links of classes are united by alternating star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import textkernel as tk
from siltstone.llm.common import connected_components, lists_of, materialize, merge_slices, slices_of, sparse_slices_of, whole_groups

#: Most shared prefix shingles that a pair can be asked for.
MAX_MULTI = 12
#: Slots of the frequency sketch, as bits: it follows the rows up to this many (a broadcast of 64 MB).
MAX_SKETCH_BITS = 25
#: Rows of one token that a task holds at once.
RUN_ROWS = 200_000
#: Postings that one task groups by set, so that tasks grow in number and not in length; tasks at most.
TASK_POSTINGS, MAX_TASKS = 75_000, 20_000
#: A unit's blocks hold about this many sets and shingles at most.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 2_000_000
#: A shingle sent and compared for a verification weighs so much against a posting scanned.
VERIFY_WEIGHT = 1.0
_UNIT = ["u_token", "u_a", "u_b"]


def _ids(token: Column) -> Column:
    """Number by which tokens are ordered and compared: all 64 bits, and one to one, so no two tokens share it."""
    return F.xxhash64(token)


def _overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


def _sketch(df: DataFrame, width: int, bits: int) -> np.ndarray:
    """Texts that hold a shingle of each slot (the top ``bits`` of the digest), over all texts.

    A task's count saturates at 255, which only evens out the order of very frequent shingles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=np.uint16)
        for batch in batches:
            for *_, values, _ in tk.shingle_sets(batch.column("text"), width):
                np.add.at(held, (values >> np.uint64(64 - bits)).astype(np.int64), np.uint16(1))
                np.minimum(held, 255, out=held)
        yield sparse_slices_of(held, TaskContext.get().partitionId())

    # A sketch has the same size for any input, so fewer and larger tasks combine more of it before the shuffle.
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // 4)
    return merge_slices(df.select("text").coalesce(tasks).mapInArrow(count, "part long, slice int, data binary"), "sparse")


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _signatures(df: DataFrame, width: int, num: int, den: int, ranks: object, bits: int) -> DataFrame:
    """(id, key, n, digest of the set, ordered prefix for the largest l) of every row."""
    schema = df.select("id").schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            ids = batch.column("id")
            for row, end, values, bounds in tk.shingle_sets(batch.column("text"), width):
                n = np.diff(bounds)
                edges = bounds.tolist()
                digests = [_digest(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                ordered = (rank[(values >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
                ordered, inner = tk.distinct(ordered, bounds)
                keep = np.where(n > 0, n - _overlap(n, num, den) + MAX_MULTI, 0)
                keep = np.minimum(keep, np.diff(inner))
                out = np.concatenate([[0], np.cumsum(keep)])
                at = np.arange(out[-1]) - np.repeat(out[:-1] - inner[:-1], keep)
                tokens = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(ordered[at].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), tokens], names=["id", "n", "digest", "tokens"])

    kind = schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(sign, f"id {kind}, n long, digest binary, tokens array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by token: the rows whose token has another row, with facts about all rows of the token.

    length: rows; weight: their shingles; kind: digest of the sets that post the token; top: largest label.  The facts are
    null for a token of more than RUN_ROWS rows, which is never held whole.
    """
    held: pa.Table | None = None
    long_token = None

    def out(table: pa.Table) -> pa.RecordBatch:
        token, node, pack = (table.column(c).to_numpy() for c in ("token", "node", "pack"))
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.concatenate([first, [len(token)]]))
        n, label = pack >> 4, (pack & 15).astype(np.int32)
        facts = [length, np.add.reduceat(n, first), np.bitwise_xor.reduceat(tk.mix(node.view(np.uint64) + np.uint64(1)).view(np.int64), first), np.maximum.reduceat(label, first)]
        is_long = token[first] == long_token if long_token is not None else np.zeros(len(first), dtype=bool)
        keep, null = np.repeat((length > 1) | is_long, length), np.repeat(is_long, length)
        columns = [token[keep], node[keep], n[keep], label[keep]]
        spread = [pa.array(np.repeat(f, length)[keep], mask=null[keep]) for f in facts]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), *spread], names=["token", "node", "n", "label", "length", "weight", "kind", "top"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        token = table.column("token").to_numpy()
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield out(table.slice(0, last))
        held = table.slice(last)
        if held.num_rows > RUN_ROWS:
            long_token = token[-1]
            yield out(held)
            held = None
    if held is not None:
        yield out(held)


def _candidates(token: int, tokens: np.ndarray, labels: np.ndarray, bounds: np.ndarray, multi: np.ndarray, n: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one unit whose l-th common prefix shingle is ``token`` and whose sizes allow a link."""
    m = len(n)
    rows = np.repeat(np.arange(m), np.diff(bounds))
    here = tokens == token
    own = np.full(m, 127, dtype=np.int64)
    own[rows[here]] = labels[here]
    before = tokens < token
    rows, tokens, labels = rows[before], tokens[before], labels[before]
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column, labels = rows[shared], column[shared], labels[shared]
    columns = np.flatnonzero(times > 1)
    column = np.searchsorted(columns, column)
    cross = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(m), np.arange(m))
    fits = (n[left][:, None] * den >= n[right][None, :] * num) & (n[right][None, :] * den >= n[left][:, None] * num)
    if not cross:
        fits &= np.arange(m)[:, None] < np.arange(m)[None, :]
    low = np.minimum(multi[left][:, None], multi[right][None, :])
    found = np.zeros_like(fits)
    for level in np.unique(multi):
        can = fits & (low == level) & (own[left] <= level)[:, None] & (own[right] <= level)[None, :]
        if not can.any():
            continue
        common = np.zeros(can.shape, dtype=np.float32)
        fit = labels <= level
        r, c = rows[fit], column[fit]
        for start in range(0, len(columns), 4096):
            part = (c >= start) & (c < start + 4096)
            if part.any():
                dense = np.zeros((m, min(4096, len(columns) - start)), dtype=np.float32)
                dense[r[part], c[part] - start] = 1
                common += dense[left] @ dense[right].T
        found |= can & (common == level - 1)
    i, j = np.nonzero(found)
    return left[i], right[j]


class _Units:
    """The units of a batch of sorted rows: prefix lists and, in the second pass, sets."""

    def __init__(self, table: pa.Table, num: int, den: int) -> None:
        self.table, self.num, self.den = table, num, den
        self.token, self.node = table.column("u_id").to_numpy(), table.column("node").to_numpy()
        self.n, self.multi, self.side = (table.column(c).to_numpy() for c in ("n", "multi", "side"))
        self.tokens, self.bounds = lists_of(table.column("tokens"))
        self.labels, _ = lists_of(table.column("labels"))

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.bounds[a], self.bounds[b]
        return _candidates(int(self.token[a]), self.tokens[lo:hi], self.labels[lo:hi], self.bounds[a : b + 1] - lo, self.multi[a:b], self.n[a:b], self.side[a:b], self.num, self.den)


def _active(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, _UNIT):
            units, keep = _Units(table, num, den), np.zeros(table.num_rows, dtype=bool)
            for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
                if b - a > 1:
                    i, j = units.pairs(a, b)
                    keep[a + i] = True
                    keep[a + j] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).to_batches()

    return run


def _verify(i: np.ndarray, j: np.ndarray, sets: np.ndarray, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs link, by exact intersection sizes."""
    n = np.diff(bounds)
    _, ids = np.unique(sets, return_inverse=True)
    mark = np.zeros(len(ids) and int(ids.max()) + 1, dtype=bool)
    linked = np.zeros(len(i), dtype=bool)
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
        mine = ids[bounds[i[a]] : bounds[i[a] + 1]]
        mark[mine] = True
        for c in range(a, b, 256):
            others = j[c : min(c + 256, b)]
            hits = mark[np.concatenate([ids[bounds[k] : bounds[k + 1]] for k in others])]
            common = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(n[others])[:-1]]))
            linked[c : c + len(others)] = den * common >= num * (n[i[a]] + n[others] - common)
        mark[mine] = False
    return linked


def _links(num: int, den: int):
    """A row for each linked set of a unit: the root of its tree in a spanning forest, and its links by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, _UNIT):
            units, copies = _Units(table, num, den), table.column("copies").to_numpy()
            sets, bounds = lists_of(table.column("shingles"))
            root = np.arange(table.num_rows)
            links = np.zeros(table.num_rows, dtype=np.int64)

            def find(x: int, root: np.ndarray = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                i, j = units.pairs(a, b)
                lo = bounds[a]
                ok = _verify(i, j, sets[lo : bounds[b]], bounds[a : b + 1] - lo, num, den) if len(i) else np.zeros(0, dtype=bool)
                i, j = i[ok] + a, j[ok] + a
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            has = np.flatnonzero(links)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(units.node[has]), pa.array(units.node[[find(int(x)) for x in has]]), pa.array(links[has])], names=["a", "b", "links"])

    return run


def _sets(df: DataFrame, width: int, wanted: np.ndarray, hashed: str) -> DataFrame:
    """(id, digest, shingles) of the rows whose id hashes into the bit map ``wanted``."""
    kind = df.schema["id"].dataType.simpleString()
    bits = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            slot = batch.column("slot").to_numpy() % (len(table) * 8)
            batch = batch.filter(pa.array((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for row, end, values, bounds in tk.shingle_sets(batch.column("text"), width):
                edges = bounds.tolist()
                digests = [_digest(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, end - row), pa.array(digests, pa.binary()), lists], names=["id", "digest", "shingles"])

    return df.select("id", "text", F.expr(hashed).alias("slot")).mapInArrow(run, f"id {kind}, digest binary, shingles array<long>")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, n_copies, n_links, component_id.

    n_shingles: size of the row's set.  n_copies: rows with the same set, itself included.  n_links: other rows it
    links with, equal sets included.  component_id: smallest id reachable by links, itself included.

    Words are runs outside white space with A-Z lower-cased; a text of fewer than ``width`` words has its whole
    sequence as its one shingle.  A null, empty or blank text has the empty set: it links with nothing
    and is its own component.  Rows that repeat an id are rows of their own; a null id never is a
    component's smallest unless all are null.  Other columns of ``df`` are not read, whatever their names.
    """
    num, den = threshold
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = min(MAX_SKETCH_BITS, max(16, math.ceil(math.log2(64 * df.count() + 1))))
    counts = _sketch(df, width, bits)
    counts = counts if len(counts) else np.zeros(1 << bits, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(np.floor(1000 * np.log2(1.0 + counts)).astype(np.uint16))
    signed = materialize(_signatures(df, width, num, den, ranks, bits), "signed")

    classes = (
        signed.where("n > 0").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = materialize(classes, "classes")

    overlap = f"-floor(-n * {num} / {den})"
    posted = classes.select("node", "n", F.posexplode("tokens").alias("at", "token"))
    posted = posted.select("token", "node", F.expr(f"cast(n as long) * 16 + greatest(1, at + 1 - (n - {overlap}))").alias("pack")).where(F.expr(f"pack % 16 <= -floor(-floor(pack / 16) * {num} / {den})"))
    posted = posted.repartition("token").sortWithinPartitions("token").mapInArrow(_runs, "token long, node long, n long, label int, length long, weight long, kind long, top int")
    posted = materialize(posted, "posted")
    tasks = min(MAX_TASKS, max(1, math.ceil(posted.count() / TASK_POSTINGS)))
    if not posted.where("length is null").isEmpty():
        bare = posted.where("length is null").select("token", "node", "n", "label")
        facts = bare.groupBy("token").agg(F.count("*").alias("length"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("kind"), F.max("label").alias("top"))
        posted = posted.where("length is not null").unionByName(bare.join(facts, "token"))

    # Shingles that are posted by the same sets are a class: to a pair they are all common or none is.  A set therefore
    # needs only the first l of those that lie in the shortest prefix of all their sets (label 1).  All that follows up
    # to the lists is grouped by set, so it needs one shuffle.
    rows = posted.repartition(tasks, "node").withColumn("id", _ids(F.col("token"))).withColumn("wide", F.col("top") > 1)
    place = F.row_number().over(Window.partitionBy("node", "kind", "length").orderBy("wide", "id"))
    rows = rows.withColumn("place", F.when(F.col("wide"), 0).otherwise(place))
    # The number l of shared shingles that each set asks for, by the true lengths of its lists: postings to scan, and
    # partners to verify; those of a class with fewer than l shingles rarely come up to it.
    entry = F.struct("token", "id", "label", "place", F.expr(f"length > {block_sets} or weight > {block_shingles}").alias("long"))
    levels = range(1, MAX_MULTI + 1)
    shares = [F.count_if(F.col("label") <= k).alias(f"m{k}") for k in levels]
    grouped = rows.groupBy("node", "kind", "length").agg(F.first("n").alias("n"), F.collect_list(entry).alias("post"), *shares)
    costs = [F.sum((F.col("length") - 1) * (F.least(f"m{k}", F.lit(k)) + VERIFY_WEIGHT * F.col("n") * F.pow(F.least(F.lit(1.0), F.col(f"m{k}") / k), 2))).alias(f"cost{k}") for k in levels]
    nodes = grouped.groupBy("node").agg(F.first("n").alias("n"), F.flatten(F.collect_list("post")).alias("post"), *costs)
    choice = ", ".join(f"struct(if({k} <= {overlap}, cost{k}, double('infinity')) as cost, {k} as multi)" for k in levels)
    nodes = nodes.withColumn("multi", F.expr(f"array_min(array({choice})).multi"))
    nodes = nodes.withColumn("post", F.expr("array_sort(transform(filter(post, p -> p.label <= multi and p.place <= multi), p -> struct(p.id, p.label, p.token, p.long)))"))
    nodes = nodes.select("node", "n", "multi", F.expr("post.id").alias("tokens"), F.expr("transform(post, p -> cast(p.label as tinyint))").alias("labels"), F.explode("post").alias("p"))
    nodes = nodes.select("node", "n", "multi", "tokens", "labels", F.col("p.token").alias("u_token"), F.col("p.id").alias("u_id"), F.col("p.long").alias("long"))
    nodes = materialize(nodes, "listed")

    # Units: a short list is one; a long list is cut by size band and digest, and pairs of near blocks meet.
    band = f"cast(floor(ln(n) / {1.000001 * math.log(den / num)!r}) as long)" if num < den else "n"
    long = nodes.where("long").withColumn("band", F.expr(band))
    cut = long.groupBy("u_token", "band").agg(F.expr(f"cast(ceil(greatest(count(*) / {block_sets}, sum(n) / {block_shingles})) as long)").alias("blocks"))
    mine = long.join(cut, ["u_token", "band"]).withColumn("mine", F.expr("pmod(xxhash64(node), blocks)"))
    near = cut.select("u_token", F.col("band").alias("other"), F.col("blocks").alias("others"))
    met = mine.withColumn("other", F.explode(F.expr("array(band - 1, band, band + 1)"))).join(near, ["u_token", "other"]).withColumn("theirs", F.explode(F.expr("sequence(0L, others - 1)")))
    a, b = "band * 1000000000 + mine", "other * 1000000000 + theirs"
    met = met.select("node", "n", "multi", "tokens", "labels", "u_token", "u_id", F.expr(f"least({a}, {b}) + 1").alias("u_a"), F.expr(f"greatest({a}, {b}) + 1").alias("u_b"), F.expr(f"cast({a} > {b} as int)").alias("side"))
    units = nodes.where("not long").select("node", "n", "multi", "tokens", "labels", "u_token", "u_id", F.lit(0).cast("long").alias("u_a"), F.lit(0).cast("long").alias("u_b"), F.lit(0).alias("side")).unionByName(met)
    active = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_active(num, den), units.schema)
    active = materialize(active, "active")

    # Whole sets of the active classes only: their representatives are found by a bit map of bounded size.
    need = materialize(classes.join(active.select("node").distinct(), "node").select("node", "rep", "copies", "digest"), "needed")
    size = 1 << min(29, max(16, math.ceil(math.log2(16 * need.count() + 1))))
    hashed = f"pmod(xxhash64(id), {size})"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size >> 3, dtype=np.uint8)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            np.bitwise_or.at(held, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        if held.any():
            yield slices_of(held, TaskContext.get().partitionId())

    wanted = merge_slices(need.select(F.expr(hashed.replace("(id)", "(rep)")).alias("slot")).mapInArrow(mark, "part long, slice int, data binary"), "or")
    sets = _sets(df, width, wanted if len(wanted) else np.zeros(size >> 3, dtype=np.uint8), hashed)
    # Sets are shuffled once to meet their classes, and once more as often as their units need them.
    sets = sets.groupBy("id", "digest").agg(F.first("shingles").alias("shingles"))
    full = active.join(need.withColumnRenamed("rep", "id"), "node").join(sets, ["id", "digest"]).drop("id", "digest")
    found = full.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_links(num, den), "a long, b long, links long")
    found = materialize(found, "links")

    components = connected_components(found.select("a", "b"))
    named = components.join(classes.select("node", "rep"), "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    classes = classes.select("digest", "node", "rep", "copies").join(linked, "node", "left").join(named, "node", "left")
    return signed.select("id", "n", "digest").join(classes.drop("node"), "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("id")).alias("component_id"),
    )
