"""Mixing sources to target weights along a time-varying curriculum, by DataFrame functions alone.

*Targets.*  Sources, by code point and null last, weigh 1, 2, 3, repeating, and share all words; a source gives at
most ``MAX_PASSES`` times its words, and what it cannot give is shared by the others by weight.

*What is taken.*  A source's documents stand in the order of a hash.  It is passed over as often as its target holds
its size; of the last, partial pass the documents before a threshold are taken, and a few more documents fill what is left.
The threshold is found from sums by (source, hash range), then exactly
inside one range.  Rows with one hash, as rows that share id and size have, follow each other in the order of their
numbers: where the threshold falls among them, as many are taken as fit.

*Positions.*  A source's weight at training time t in [0, 1] is target * (1 + a * (2 t - 1)); its integral is its
target.  A document taken when the source has given the share u of its target stands where the integral reaches u,
the root of a quadratic; occurrences of all sources are range-sorted by that position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize

MAX_PASSES = 3
#: Slope of a source's schedule, by its weight: light sources early, heavy ones late.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}
#: Tables by source are broadcast up to this many rows (a few MB), and joined by a shuffle beyond it.
BROADCAST_ROWS = 50_000
#: Rows of a source that one hash range should hold, and the most ranges as bits.
RANGE_ROWS, RANGE_BITS = 4096, 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _order(id_col: str, size: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(size), F.lit(17))


#: Sources as a join key in which null is a value.
def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with its row's place, from 0, in a total order: ranges of it are sorted apart, and their sizes added up."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # The id of a row is its partition, in the order of ranges, and its number in it.
    rows = materialize(rows.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    starts = rows.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    starts = starts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_start", "_at")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (key, source, source_size), one row a source.

    A source is full where its weight times the common share exceeds what it can give.  The share over the sources that
    are not full only grows as sources become full, so it is found by a few sums over the table of sources.
    """
    w = numbered(sizes, F.col("source").asc_nulls_last(), name="place").withColumn("weight", (F.pmod("place", F.lit(3)) + 1).cast("int"))
    w = w.withColumn("most", F.lit(MAX_PASSES) * F.col("source_size"))
    total, weights = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share, given, n_full = (total / weights if weights else 0.0), 0, -1
    while weights:
        full = F.col("weight") * share > F.col("most")
        n, given, open_ = w.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == n_full or not open_:
            break
        share, n_full = (total - given) / open_, n
    target = F.least(F.col("weight") * F.lit(float(share)), F.col("most").cast("double"))
    return w.select("key", "source", "source_size", "weight", target.alias("target"))


class Mix:
    """The plan: ``sources`` (a row a source) and ``ranges`` (a row a source and hash range), of known sizes."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> None:
        self.id_col, self.text_col, self.source_col, self.row_col = id_col, text_col, source_col, row_col
        size = n_words(F.col(text_col))
        row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
        slim = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row"))
        self.slim = slim = materialize(slim.select("row", "id", _key(F.col("source")).alias("key"), "source", "size", _order("id", "size").alias("h")), "sizes")
        sizes = slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        sizes = materialize(sizes, "sources")
        self.n_sources, most = sizes.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
        self.bits = min(RANGE_BITS, max(4, math.ceil(math.log2(max(most, 1) / RANGE_ROWS + 1))))

        ranges = slim.groupBy("key", self.range_of().alias("range")).agg(F.sum("size").alias("range_size"))
        # A source has at most 2 ** RANGE_BITS ranges, so a window of one source holds no more rows.
        before = F.sum("range_size").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        self.ranges = ranges = materialize(ranges.withColumn("before", F.coalesce(before, F.lit(0))), "ranges")
        self.n_ranges = ranges.count()

        plan = targets(sizes.drop("rows"))
        plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12)).otherwise(0).cast("long"))
        plan = plan.withColumn("left", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
        # The range in which the last pass ends, and inside it the last hash before the end.
        last = ranges.join(_small(plan.select("key", "left"), self.n_sources), "key").where("before <= left and left < before + range_size")
        inside = slim.withColumn("range", self.range_of()).join(_small(last.select("key", "range", "before", "left"), self.n_sources), ["key", "range"])
        inside = inside.groupBy("key", "h").agg(F.first("before").alias("before"), F.first("left").alias("left"), F.sum("size").alias("s"), F.count("*").alias("n"))
        inside = inside.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
        fits = F.col("upto") <= F.col("left")
        inside = inside.groupBy("key").agg(F.max(F.when(fits, F.col("h"))).alias("inner"), F.max(F.when(fits, F.col("upto"))).alias("reached"), F.min(F.when(~fits, F.struct("h", "s", "n"))).alias("over"))
        ends = last.select("key", F.col("range").alias("end_range"), "before", "left").join(_small(inside, self.n_sources), "key", "left")
        ends = ends.withColumn("reached", F.coalesce("reached", "before")).withColumn("each", F.col("over.s") / F.col("over.n"))
        # Of several rows with the hash that is too much, those that fit.
        fit = F.when(F.col("over.n") > 1, F.floor((F.col("left") - F.col("reached")) / F.col("each")))
        ends = ends.select("key", "end_range", F.col("inner").alias("end_h"), "reached", "each", F.col("over.h").alias("tie_h"), F.coalesce(fit, F.lit(0)).alias("fit"))
        ends = self._ties(materialize(ends, "last"))
        plan = plan.join(_small(ends, self.n_sources), "key", "left").withColumn("gap", F.coalesce(F.col("left") - F.col("reached"), F.lit(0.0)))
        plan = materialize(plan, "ends")
        self.sources = materialize(plan.join(_small(self._fills(plan), self.n_sources), "key", "left"), "plan")

    def _ties(self, ends: DataFrame) -> DataFrame:
        """``ends`` with tie_row, the last row that is taken of those with the hash ``tie_h``, and what is reached by it."""
        some = ends.where("fit > 0").select("key", "tie_h", "fit")
        if some.isEmpty():
            return ends.withColumn("tie_row", F.lit(None).cast("long"))
        # Ties can be any share of a source, so they are numbered over ranges of the table.
        ties = self.slim.join(_small(some, self.n_sources), "key").where("h = tie_h").select("key", "row", "fit")
        ties = numbered(ties, F.col("key"), F.col("row"), name="place")
        least = ties.groupBy("key").agg(F.min("place").alias("least"))
        ties = ties.join(_small(least, self.n_sources), "key").where("place - least = fit - 1").select("key", F.col("row").alias("tie_row"))
        reached = F.col("reached") + F.when(F.col("tie_row").isNotNull(), F.col("fit") * F.col("each")).otherwise(0)
        return ends.join(_small(ties, self.n_sources), "key", "left").withColumn("reached", reached)

    def _fills(self, plan: DataFrame) -> DataFrame:
        """(key, fills): rows of documents of the rest of the last pass that together come nearest to what is left.

        Of each power of two of sizes the smallest and the largest document that fits are candidates, a number that the
        bits of a size bound; they are taken from large to small while they fit.  One that is too large is taken alone if
        it comes nearer.
        """
        wanting = plan.where("gap > 0").select("key", "end_range", "end_h", "tie_h", "tie_row", "gap")
        rest = self.slim.join(_small(wanting, self.n_sources), "key").where(~self.before_end() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
        one, fits = F.struct("size", "h", "row"), F.col("size") <= F.col("gap")
        by_size = rest.groupBy("key", F.floor(F.log2("size")).alias("power")).agg(F.first("gap").alias("gap"), F.min(F.when(fits, one)).alias("low"), F.max(F.when(fits, one)).alias("high"), F.min(F.when(~fits, one)).alias("over"))
        listed = by_size.groupBy("key").agg(F.first("gap").alias("gap"), F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array("high", "low"))))).alias("some"), F.min("over").alias("over"))
        begin = F.struct(F.col("gap").alias("left"), F.array().cast("array<long>").alias("fills"))
        taken = lambda got, c: F.struct((got["left"] - c["size"]).alias("left"), F.concat(got["fills"], F.array(c["row"])).alias("fills"))
        listed = listed.withColumn("got", F.aggregate(F.sort_array("some", False), begin, lambda got, c: F.when(c["size"] <= got["left"], taken(got, c)).otherwise(got)))
        alone = F.coalesce(F.col("over.size") - F.col("gap") < F.col("got.left"), F.lit(False))
        return listed.select("key", F.when(alone, F.array("over.row")).otherwise(F.col("got.fills")).alias("fills"))

    def range_of(self) -> Column:
        """Range of the hash: its leading bits, in the hash's own (signed) order."""
        return F.expr(f"shiftright(h, {64 - self.bits})")

    def before_end(self) -> Column:
        """Whether the last pass takes the row, by order; no end: it takes none."""
        own = self.range_of()
        inside = (own == F.col("end_range")) & (F.col("h") <= F.col("end_h"))
        tied = (F.col("h") == F.col("tie_h")) & (F.col("row") <= F.col("tie_row"))
        return F.coalesce(own < F.col("end_range"), F.lit(False)) | F.coalesce(inside, F.lit(False)) | F.coalesce(tied, F.lit(False))

    def copies(self) -> Column:
        extra = self.before_end() | F.coalesce(F.array_contains("fills", F.col("row")), F.lit(False))
        return F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(F.least(F.col("passes") + extra.cast("long"), F.lit(MAX_PASSES)))

    def planned(self) -> DataFrame:
        """(id, source, size, source_size, target, copies, taken) for every document."""
        rows = self.slim.join(_small(self.sources.drop("source"), self.n_sources), "key")
        return rows.select("id", "source", "size", "source_size", "target", self.copies().alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))

    def occurrences(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with row, key, size and h) once for each time they are taken, with mix_pass and mix_position."""
        columns = rows.columns
        rows = rows.withColumn("range", self.range_of()).join(_small(self.ranges, self.n_ranges), ["key", "range"])
        rows = rows.join(_small(self.sources.drop("source"), self.n_sources), "key")
        within = F.expr(f"(h - shiftleft(range, {64 - self.bits})) / pow(2, {64 - self.bits})")
        rows = rows.withColumn("mix_pass", F.explode(F.expr("sequence(1, 3)"))).where(F.col("mix_pass") <= self.copies())
        share = F.least(F.lit(1.0), ((F.col("mix_pass") - 1) * F.col("source_size") + F.col("before") + within * F.col("range_size")) / F.greatest("target", F.lit(1e-9)))
        slope = F.lit(0.0)
        for weight, a in SLOPES.items():
            slope = F.when(F.col("weight") == weight, F.lit(a)).otherwise(slope)
        root = F.when(slope == 0, share).otherwise((slope - 1 + F.sqrt(F.pow(1 - slope, 2) + 4 * slope * share)) / (2 * slope))
        return rows.select(*columns, "mix_pass", root.alias("mix_position"))

    def ordered(self, documents: DataFrame) -> DataFrame:
        """The columns of ``documents`` with mix_pass and mix_position: a row for each occurrence, range-sorted.

        A row is known by the column ``row_col``; without one the rows are written with numbers first.
        """
        if self.row_col is None:
            return ordered_mix(documents, self.id_col, self.text_col, self.source_col)
        columns = [F.col(f"`{c}`") for c in documents.columns if c not in ("mix_pass", "mix_position", self.row_col)]
        rows = documents.select(F.struct(*columns).alias("kept"), F.col(self.row_col).alias("row"), n_words(F.col(self.text_col)).alias("size"), _key(F.col(self.source_col)).alias("key"), F.col(self.id_col).alias("id"))
        rows = self.occurrences(rows.select("kept", "row", "size", "key", _order("id", "size").alias("h")))
        # Rows that share id and size share a position, so the number of the row deals them to ranges.
        rows = rows.repartitionByRange("mix_position", "row").sortWithinPartitions("mix_position", "row")
        return rows.select("kept.*", "mix_pass", "mix_position")

    def placed(self) -> DataFrame:
        """``planned`` from the occurrences themselves, with mix_positions and mix_places, both by pass.

        A place counts the occurrences before it in the range-sorted order of training; a document that is never taken
        has empty lists.
        """
        rows = numbered(self.occurrences(self.slim.select("row", "key", "size", "h")), F.col("mix_position"), F.col("h"), F.col("mix_pass"), F.col("row"), name="place")
        taken = rows.groupBy("row").agg(
            F.sum("size").alias("taken"),
            F.count("*").alias("copies"),
            F.array_sort(F.collect_list(F.struct("mix_pass", "mix_position", "place"))).alias("given"),
        )
        every = self.slim.join(_small(self.sources.select("key", "target", "source_size"), self.n_sources), "key").join(taken, "row", "left")
        none = F.coalesce("given", F.array().cast("array<struct<mix_pass:int,mix_position:double,place:bigint>>"))
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("copies", "taken")]
        return every.select("id", "source", "size", "source_size", "target", *counts, none["mix_position"].alias("mix_positions"), none["place"].alias("mix_places"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> Mix:
    """Plan the mix of ``documents``; see ``Mix.planned``, ``Mix.ordered`` and ``Mix.placed``.

    Sizes count words of whole texts; a null or empty text has size 0 and occurs as often as its source is passed
    over.  Null is a source of its own and stands last.  Rows are told apart by ``row_col`` (long, no two alike) or by
    the order in which they are read: rows that share id, null ones too, and size are as many documents, of which as
    many are taken as the target asks for.  Reruns agree on ids, sizes and words taken, whichever of such rows come first.  An empty table
    gives an empty plan.  Clashing columns: mix_pass and mix_position are replaced.
    """
    return Mix(documents, id_col, text_col, source_col, row_col)


def ordered_mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``Mix.ordered`` of ``documents``, which are written once with numbers that tell their rows apart."""
    names = {c: f"c{k}" for k, c in enumerate(documents.columns) if c not in ("mix_pass", "mix_position")}
    rows = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "numbered-documents")
    mixed = Mix(rows, names[id_col], names[text_col], names[source_col], "row").ordered(rows)
    return mixed.toDF(*names, "mix_pass", "mix_position")
