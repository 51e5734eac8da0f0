"""Benchmark decontamination by size-partitioned MinHash containment, by DataFrame functions alone.

Items are partitioned by their number of shingles, in powers of two.  A partition fixes the length of its bottom-k MinHash
signatures: an item that a document contains to ``threshold`` misses at most n - ceil(threshold * n) shingles, so of any
one more than that many at least one is in the document.  The signature therefore holds the
u - ceil(threshold * u) + 1 smallest shingle hashes, u being the partition's largest size.

A long document holds smaller hashes than an item in it, so its own k smallest say nothing.  Its sketch is a share of hash space
instead: all its shingle hashes up to the largest one of the signatures of that width, which is what
a bottom-k signature can meet.  The share of a signature that is in the sketch estimates containment without bias, and
the least share of a partition is set so that no item is missed; exact containment of all shingles then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize

#: Item shingles are broadcast to the scan up to this number (about 20 MB), and joined by a shuffle beyond it.
BROADCAST_SHINGLES = 400_000
#: Parts into which the rows of one shingle are dealt when it is joined by a shuffle.
SALTS = 16
#: Pairs of candidates are broadcast up to this number (about 30 MB), and joined by a shuffle beyond it.
BROADCAST_PAIRS = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _runs(hashes: str, width: int) -> Column:
    """Hash of every run of ``width`` words; none if there are fewer."""
    at = ", ".join(f"{hashes}[i + {k}]" for k in range(width))
    return F.expr(f"if(size({hashes}) < {width}, array(), transform(sequence(0, greatest(size({hashes}) - {width}, 0)), i -> xxhash64({at}, {width})))").cast("array<long>")


def _meet(shingles: DataFrame, entries: DataFrame, small: bool) -> DataFrame:
    """Shingles (doc, h) with the entries (h, ...) of that hash.

    ``entries`` are broadcast if they are ``small``.  Else a shingle that many documents share is dealt to ``SALTS`` tasks by
    the document, and its entries to all of them.
    """
    if small:
        return shingles.join(F.broadcast(entries), "h")
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return shingles.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")


def candidates(shingles: DataFrame, signatures: DataFrame, small: bool = True) -> DataFrame:
    """(doc, item) where the shingles (doc, h) hold ``least`` or more of a signature (h, item, least)."""
    met = _meet(shingles, signatures, small).groupBy("doc", "item", "h").agg(F.first("least").alias("least"))
    return met.groupBy("doc", "item").agg(F.first("least").alias("least"), F.count("*").alias("hits")).where("hits >= least").select("doc", "item")


def shares(signatures: DataFrame) -> dict[int, int]:
    """By width, the largest hash of any signature (h, width): up to there a document's hashes are sketched."""
    return {r["width"]: r["most"] for r in signatures.groupBy("width").agg(F.max("h").alias("most")).collect()}  # a row a width


def sketches(docs: DataFrame, most: dict[int, int]) -> DataFrame:
    """(doc, h): the shingle hashes of (doc, text) up to the bound of their width."""
    hashed = docs.select("doc", _hashes(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    upto = lambda bound: lambda h: h <= F.lit(bound)
    parts = [F.filter(_runs("w", k), upto(bound)) for k, bound in sorted(most.items())]
    return hashed.select("doc", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("h"))


def contaminated(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(``id_col``, ``item_id_col``, n_item_shingles, n_shared, containment) of the documents that contain items.

    containment is the share of the item's distinct word shingles that the document has, ``threshold`` or more.  Words
    are runs outside white space, lower-cased.  An item of fewer than ``width`` words has its whole sequence as its one
    shingle and is searched as such; an item without words is in no document.  Null texts are empty.  Rows that repeat
    an item's id and text are one item; rows that repeat a document's id are one document with all their shingles.
    Rows with null ids are ignored.  Other columns are not read.
    """
    items = items.select(F.col(item_id_col).alias("item"), _hashes(F.coalesce(F.col(item_text_col), F.lit(""))).alias("w")).where("item is not null and size(w) > 0").dropDuplicates()
    items = items.withColumn("width", F.least(F.size("w"), F.lit(width)))
    used = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    docs_kind = documents.schema[id_col].dataType.simpleString()
    if not used:
        return documents.sparkSession.createDataFrame([], f"{id_col} {docs_kind}, {item_id_col} {items.schema['item'].dataType.simpleString()}, n_item_shingles long, n_shared long, containment double")
    pick = F.lit(None).cast("array<long>")
    for k in used:
        pick = F.when(F.col("width") == k, _runs("w", k)).otherwise(pick)
    marked = F.transform(pick, lambda h: F.struct(h.alias("h"), F.col("width").alias("width")))
    items = items.select("item", F.array_distinct(marked).alias("s")).groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    n = "size(s)"
    largest = f"cast(pow(2, ceil(log2({n}))) as int)"
    spare = lambda size: f"({size} - cast(ceil({threshold} * {size} - 1e-9) as int))"
    items = items.select("item", "s", F.expr(f"{n}").alias("n"), F.expr(f"slice(array_sort(s), 1, {spare(largest)} + 1)").alias("signature"), F.expr(spare(n)).alias("spare"))
    items = materialize(items, "items")
    small = items.agg(F.sum("n")).first()[0] <= BROADCAST_SHINGLES
    signatures = items.select(F.explode("signature").alias("x"), "item", F.expr("greatest(size(signature) - spare, 1)").alias("least")).select("x.*", "item", "least")
    entries = items.select(F.explode("s.h").alias("h"), "item", "n")

    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    pairs = materialize(candidates(sketches(docs, shares(signatures)), signatures.drop("width"), small), "pairs")
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    # Only texts of candidates are hashed again, in full, and their shingles meet those of the items they are candidates for.
    whole = sketches(docs.join(pairs.select("doc"), "doc", "left_semi"), dict.fromkeys(used, (1 << 63) - 1))
    met = _meet(whole, entries, small).join(pairs, ["doc", "item"], "left_semi")
    met = met.groupBy("doc", "item", "h").agg(F.first("n").alias("n"))
    met = met.groupBy("doc", "item").agg(F.first("n").alias("n"), F.count("*").alias("shared"))
    met = met.withColumn("containment", F.col("shared") / F.col("n")).where(F.col("containment") >= threshold)
    return met.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), F.col("n").cast("long").alias("n_item_shingles"), F.col("shared").alias("n_shared"), "containment")
