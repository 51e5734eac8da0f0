"""Co-occurrence graphs, their maintenance, personalised PageRank and graph reranking.

A graph is kept as provenance rows (a, b, source), a < b, one for each source in which both ends occur: no cell grows with
the sources of an edge, and an edge's weight is its number of rows.  Pairs inside a group (a paper, a chunk) come from a
self-join on the group after its members are made distinct, so a group of m members gives m (m - 1) / 2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import dealt, row_tasks

DAMPING, ROUNDS, TOP_ENTITIES, TOLERANCE, SECOND_TOLERANCE = 0.9, 30, 50, 1e-6, 1e-3
#: Nodes of a block of ranks (1 MB) and edges of a unit (about 10 MB), on average.
BLOCK_NODES, UNIT_EDGES, SLOT_BITS = 1 << 17, 1 << 19, 32


def pairs(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, a, b) for the distinct lower-cased members of each group, a < b."""
    # Dealt by group once: the distinct rows and both sides of the join lie as they are needed.
    one = members.where(F.col(member).isNotNull()).select(F.col(group).alias("g"), F.lower(member).alias("e"))
    one = dealt(one, "g").distinct()
    other = one.select("g", F.col("e").alias("b"))
    return one.withColumnRenamed("e", "a").join(other, "g").where("a < b")


def heading_rows(links: DataFrame, names: DataFrame, paper: str, heading: str, name: str) -> DataFrame:
    """Provenance rows of heading pairs of a paper in id order, named canonically; equal names make a loop.

    Pairs of headings with the same names repeat a row.
    """
    label = names.select(F.col(heading).alias("x"), F.lower(name).alias("lx"))
    # Dealt by paper once, with the names: a heading is named before its pairs are made, not after.
    left = links.select(F.col(paper).alias("p"), F.col(heading).alias("x")).distinct().join(label, "x")
    left = dealt(left, "p")
    right = left.select("p", F.col("x").alias("y"), F.col("lx").alias("ly"))
    both = left.join(right, "p").where("x < y")
    return both.select(F.least("lx", "ly").alias("a"), F.greatest("lx", "ly").alias("b"), F.col("p").alias("source"))


def entity_rows(members: DataFrame, group: str, member: str) -> DataFrame:
    """Provenance rows of the entities of each chunk."""
    return pairs(members, group, member).select("a", "b", F.col("g").alias("source"))


def weighted(rows: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight) of provenance rows with ``least`` sources or more: partial counts meet, nothing is collected."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def merged(*graphs: DataFrame, least: list[int] | None = None) -> DataFrame:
    """(a, b, weight, n_sources) of several graphs' rows: weights add up, sources unite, both directions are one edge.

    An edge of graph k counts from ``least[k]`` sources on.  Rows may repeat.  Sources are told apart by which graphs have
    them, and only these few counts of an edge meet.
    """
    every = None
    for k, g in enumerate(graphs):
        part = g.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "source", F.lit(1 << k).alias("mask"))
        every = part if every is None else every.unionByName(part)
    by_mask = every.groupBy("a", "b", "source").agg(F.bit_or("mask").alias("mask")).groupBy("a", "b", "mask").agg(F.count("*").alias("n"))
    bits = [(1 << k, (least or [1] * len(graphs))[k]) for k in range(len(graphs))]
    has = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) != 0
    edges = by_mask.groupBy("a", "b").agg(F.collect_list(F.struct("mask", "n")).alias("counts"), *(F.coalesce(F.sum(F.when(has(bit), F.col("n"))), F.lit(0)).alias(f"w{bit}") for bit, _ in bits))
    kept, weight = F.lit(0), F.lit(0).cast("long")
    for bit, low in bits:
        kept = kept + F.when(F.col(f"w{bit}") >= low, bit).otherwise(0)
        weight = weight + F.when(F.col(f"w{bit}") >= low, F.col(f"w{bit}")).otherwise(0)
    edges = edges.select("a", "b", weight.alias("weight"), "counts", kept.alias("kept")).where("kept <> 0")
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda x, c: x + F.when(c["mask"].bitwiseAND(F.col("kept")) != 0, c["n"]).otherwise(0))
    return edges.select("a", "b", "weight", n.alias("n_sources"))


def increment(rows: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """The rows with those of chunks that no row has as a source yet: applying it twice changes nothing."""
    known = rows.select(F.col("source").alias(group)).distinct()
    return rows.unionByName(entity_rows(members.join(known, group, "left_anti"), group, member))


def symmetric(graph: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, weight) in both directions of edges of ``least`` weight or more, self-loops once."""
    kept = graph.where(F.col("weight") >= least)
    # Both directions come from one row, so that the edges are not computed twice.
    there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("b", "a")))
    ways = F.explode(F.when(F.col("a") != F.col("b"), F.array(there, back)).otherwise(F.array(there)))
    return kept.select(ways.alias("way"), "weight").select("way.src", "way.dst", "weight")


def personalised_pagerank(edges: DataFrame, seeds: list[str], rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, one_task_edges: int = UNIT_EDGES, block_nodes: int = BLOCK_NODES, unit_edges: int = UNIT_EDGES) -> DataFrame:
    """(node, rank) by power iteration over (src, dst, weight), weights above 0, restarting uniformly at the seeds that are nodes.

    Starts uniform over all nodes; what nodes without out-edges hold goes to the seeds.  Ends when the ranks' summed change
    falls below nodes * ``tolerance``, or after ``rounds``; a tolerance of 0 runs them all.  If the last change is above
    nodes * 1e-3 too, it fails.  Empty without a valid seed.  Edges with a null end are left out, repeated edges add up.

    A graph is iterated by units of edges (``_rank_by_blocks``).  One of a single unit has nothing to exchange and runs its
    rounds inside that unit's task, with the same ranks.
    """
    seeds = sorted({s.lower() for s in seeds})
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    if edges.count() <= one_task_edges:
        return _rank_one_unit(edges, seeds, rounds, damping, tolerance)
    return _rank_by_blocks(edges, seeds, rounds, damping, tolerance, block_nodes, unit_edges)


def _settled(change: float, nodes: int, last: bool, tolerance: float) -> bool:
    if tolerance and last and change >= nodes * SECOND_TOLERANCE:
        raise ValueError(f"ranks still move by {change}")
    return last or change < nodes * tolerance


def _rank_one_unit(edges: DataFrame, seeds: list[str], rounds: int, damping: float, tolerance: float) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(frames)
        rows = pd.concat(every) if every else pd.DataFrame({"src": [], "dst": [], "weight": []})
        codes, nodes = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True))
        n, seed = len(nodes), np.isin(nodes.astype(str), seeds).astype(float) if len(nodes) else np.zeros(0)
        if not seed.sum():
            return
        src, dst, seed = codes[: len(rows)], codes[len(rows) :], seed / seed.sum()
        out = np.bincount(src, weights=rows["weight"], minlength=n)
        share, dead, rank = rows["weight"].to_numpy() / out[src], out == 0, np.full(n, 1.0 / n)
        for k in range(rounds):
            flow = np.bincount(dst, weights=share * rank[src], minlength=n) + rank[dead].sum() * seed
            new = damping * flow + (1 - damping) * seed
            change, rank = np.abs(new - rank).sum(), new
            if _settled(change, n, k == rounds - 1, tolerance):
                break
        yield pd.DataFrame({"node": nodes, "rank": rank})

    return edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).coalesce(1).mapInPandas(run, f"node {kind}, rank double")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each unit of edges sends to the blocks of its targets: sorted slots and their sums."""
    for batch in batches:
        held = {c: batch.column(c) for c in ("src", "dst", "weight", "flow")}
        for k in range(batch.num_rows):
            src, dst, weight, flow = (held[c][k].values.to_numpy() for c in held)
            new = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            sums, to = np.add.reduceat(weight * flow[src], new), dst[new]
            block = (to >> SLOT_BITS).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            offsets = pa.array(np.append(cut, len(to)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((to & ((1 << SLOT_BITS) - 1)).astype(np.int32), sums)]
            origin = np.full(len(cut), batch.column("unit")[k].as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(origin), *lists], names=["block", "origin", "slots", "sums"])


def _rank_by_blocks(edges: DataFrame, seeds: list[str], rounds: int, damping: float, tolerance: float, block_nodes: int, unit_edges: int) -> DataFrame:
    """Ranks lie in blocks of about ``block_nodes`` nodes, edges in units of about ``unit_edges`` with one block of sources.

    Nodes get numbers once, so no name is moved in a round.  A block with many edges, as that of a hub, has several units,
    dealt by target.  In a round the units, which stay where they are, meet the ranks of their block, and only sums by
    target, already added up in each unit, are exchanged.  The ranks of every round are checkpointed.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().checkpoint()
    n = nodes.count()
    blocks = -(-n // block_nodes)
    in_block = Window.partitionBy("block").orderBy("node")
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn("slot", F.row_number().over(in_block) - 1).checkpoint()
    # As many rows as there are seeds.
    seeded: dict[int, list[int]] = {}
    for r in nodes.where(F.col("node").cast("string").isin(seeds)).select("block", "slot").collect():
        seeded.setdefault(r["block"], []).append(r["slot"])
    if not seeded:
        return nodes.where("false").select("node", F.lit(0.0).alias("rank"))
    restart = 1.0 / sum(len(x) for x in seeded.values())

    code = F.shiftleft(F.col("block").cast("long"), SLOT_BITS) + F.col("slot")
    coded = edges.join(nodes.select(F.col("node").alias("src"), F.col("block"), F.col("slot").alias("s")), "src")
    coded = coded.join(nodes.select(F.col("node").alias("dst"), code.alias("d")), "dst").select("block", "s", "d", F.col("weight").cast("double").alias("weight")).checkpoint()
    sizes = coded.groupBy("block").agg(F.ceil(F.count("*") / unit_edges).alias("parts")).checkpoint()
    unit = F.shiftleft(F.col("block").cast("long"), SLOT_BITS) + F.pmod(F.xxhash64("d"), F.col("parts"))
    sorted_edges = F.sort_array(F.collect_list(F.struct("d", "s", "weight")))
    units = coded.join(sizes, "block").groupBy(unit.alias("unit")).agg(sorted_edges.alias("e"))
    units = units.select("unit", F.col("e.s").alias("src"), F.col("e.d").alias("dst"), F.col("e.weight").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)

    out = nodes.join(coded.groupBy("block", F.col("s").alias("slot")).agg(F.sum("weight").alias("out")), ["block", "slot"], "left")
    out = out.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("out", F.lit(0.0)).alias("out")))).alias("o"))
    state = out.select("block", F.col("o.out").alias("out"), F.transform("o", lambda _: F.lit(1.0 / n)).alias("ranks")).checkpoint()
    dead_mass = F.aggregate(F.zip_with("out", "ranks", lambda o, r: F.when(o == 0, r).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    lost = state.agg(F.sum(dead_mass)).first()[0]
    for k in range(rounds):
        flow = F.zip_with("ranks", "out", lambda r, o: F.when(o > 0, r / o).otherwise(0.0))
        sent = state.join(sizes, "block").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block", flow.alias("flow"))
        sent = sent.select((F.shiftleft(F.col("block").cast("long"), SLOT_BITS) + F.col("part")).alias("unit"), "flow")
        sums = units.join(sent, "unit").mapInArrow(_products, "block int, origin long, slots array<int>, sums array<double>")
        every = sums.unionByName(state.select("block", F.lit(-1).cast("long").alias("origin"), "out", "ranks"), allowMissingColumns=True)

        def settle(batches: Iterator[pa.RecordBatch], lost=lost) -> Iterator[pa.RecordBatch]:
            block = out = old = flow = None

            def done() -> pa.RecordBatch:
                seed = np.zeros(len(old))
                seed[seeded.get(block, [])] = restart
                new = damping * (flow + lost * seed) + (1 - damping) * seed
                lists = [pa.array([x], pa.list_(pa.float64())) for x in (out, new)]
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *lists, pa.array([np.abs(new - old).sum()]), pa.array([new[out == 0].sum()])], names=["block", "out", "ranks", "change", "lost"])

            for batch in batches:
                held = {c: batch.column(c) for c in batch.schema.names}
                for k in range(batch.num_rows):
                    if held["origin"][k].as_py() < 0:  # a block's own row comes first
                        if block is not None:
                            yield done()
                        block, out, old = held["block"][k].as_py(), *(held[c][k].values.to_numpy() for c in ("out", "ranks"))
                        flow = np.zeros(len(old))
                    else:
                        flow[held["slots"][k].values.to_numpy()] += held["sums"][k].values.to_numpy()
            if block is not None:
                yield done()

        every = every.repartition("block").sortWithinPartitions("block", "origin")
        state = every.mapInArrow(settle, "block int, out array<double>, ranks array<double>, change double, lost double").checkpoint()
        change, lost = state.agg(F.sum("change"), F.sum("lost")).first()
        state = state.drop("change", "lost")
        if _settled(change, n, k == rounds - 1, tolerance):
            break
    units.unpersist()
    return state.select("block", F.posexplode("ranks").alias("slot", "rank")).join(nodes, ["block", "slot"]).select("node", "rank")


def top_entities(ranks: DataFrame, n: int = TOP_ENTITIES) -> DataFrame:
    return ranks.orderBy(F.desc(F.round("rank", 12)), "node").limit(n)


def chunk_boosts(members: DataFrame, ranks: DataFrame, chunk: str, member: str, boost: float = 1.0) -> DataFrame:
    """(chunk, boost): sum of the ranks of a chunk's distinct entities.  ``ranks`` are the few top entities."""
    # Only what the ranks name is dealt, once by chunk, to as many tasks as all members would need.
    some = members.select(F.col(chunk).alias("chunk"), F.lower(member).alias("node")).join(F.broadcast(ranks), "node")
    one = some.repartition(row_tasks(members), "chunk").dropDuplicates(["chunk", "node"])
    return one.groupBy("chunk").agg((boost * F.sum("rank")).alias("boost"))


def descendants(terms: DataFrame, roots: DataFrame, term: str, paths: str) -> DataFrame:
    """(root, ``term``): terms with a path strictly below one of the root's paths.

    Each path is exploded into its dotted ancestors, so the join is an equality instead of a prefix comparison.
    """
    every = terms.select(term, F.explode(paths).alias("path"))
    parts = F.split("path", r"\.")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    below = every.select(term, F.explode(above).alias("ancestor"))
    root = roots.select(F.col(term).alias("root"), F.explode(paths).alias("ancestor"))
    return below.join(root, "ancestor").select("root", term).distinct()


def expand(terms: DataFrame, roots: DataFrame, term: str, paths: str) -> DataFrame:
    """(root, members): each root with itself and its descendants, sorted."""
    below = descendants(terms, roots, term, paths).unionByName(roots.select(F.col(term).alias("root"), F.col(term)))
    return below.groupBy("root").agg(F.sort_array(F.collect_set(term)).alias("members"))


def autocomplete(terms: DataFrame, name: str, prefix: str, n: int) -> DataFrame:
    return terms.where(F.startswith(F.lower(name), F.lit(prefix.lower()))).select(name).distinct().orderBy(name).limit(n)


def named_or_synonym(terms: DataFrame, name: str, synonyms: str, value: str) -> DataFrame:
    """Rows whose name or one of whose synonyms equals ``value``, case ignored."""
    same: Column = F.lower(name) == value.lower()
    return terms.where(same | F.coalesce(F.exists(synonyms, lambda s: F.lower(s) == value.lower()), F.lit(False)))


def dictionary_entities(docs: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str) -> DataFrame:
    """(``id_col``, entity): the known one-word names that a text holds, case ignored; the stand-in for a model's tagger."""
    words = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("entity"))
    return words.join(names.select(F.lower(name).alias("entity")).distinct(), "entity", "left_semi")


def phrase_entities(docs: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str) -> DataFrame:
    """(``id_col``, entity, times): the known names, of any number of words, that a text holds, case and marks ignored.

    Runs of as many words as some name has meet the names by an equality join; a name inside a longer one counts too.
    Names without a word are never found.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    known = names.select(words(F.col(name)).alias("w")).where(F.size("w") > 0).select(F.array_join("w", " ").alias("entity"), F.size("w").alias("width")).distinct()
    # As many rows as there are numbers of words in a name.
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())
    texts = docs.select(id_col, words(F.col(text_col)).alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    every = None
    for n in widths:
        part = texts.where(F.size("w") >= n).select(id_col, F.explode(runs(n)).alias("entity"))
        every = part if every is None else every.unionByName(part)
    if every is None:
        return texts.where("false").select(id_col, F.lit("").alias("entity"), F.lit(0).cast("long").alias("times"))
    return every.join(known.select("entity"), "entity", "left_semi").groupBy(id_col, "entity").agg(F.count("*").alias("times"))


def expand_terms(terms: DataFrame, tree: DataFrame, term: str, name: str, paths: str) -> DataFrame:
    """(query_term, names): for each given name, itself and the names of all descriptors below it."""
    roots = tree.join(terms.select(F.lower("query_term").alias("_q"), "query_term"), F.lower(name) == F.col("_q"))
    below = descendants(tree, roots.select(term, paths).distinct(), term, paths).join(tree.select(term, F.col(name).alias("found")), term)
    every = below.select("root", "found").unionByName(roots.select(F.col(term).alias("root"), F.col(name).alias("found")))
    return roots.select(F.col(term).alias("root"), "query_term").join(every, "root").groupBy("query_term").agg(F.sort_array(F.collect_set("found")).alias("names"))
