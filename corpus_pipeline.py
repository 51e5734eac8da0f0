"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
gives it to the next stage.  All stages but the last return the columns of ``documents``.

In every stage a row is decided by its own text: rows that repeat an id are rows of their own, and null ids are as good as
others.  A null or empty text is clean, near to nothing and of size 0.  Empty tables give empty results.  Other columns go
along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize
from siltstone.llm.decontamination import contaminated
from siltstone.llm.jaccard_join import jaccard_join
from siltstone.llm.mixing import ordered_mix
from siltstone.llm.queries import SHARD_BYTES, table
from siltstone.llm.sharding import shard
from siltstone.llm.toxicity import without_toxic

#: Ids to drop are broadcast up to this number (about 30 MB), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names of its own for the columns, and these by the old ones."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", cut=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document with the smallest id stays, once.

    Groups and survivors are of rows: a reused id does not join texts that are not linked, and a null id, which stands
    last, is a document of its own.  Rows without words are in no group; of those that repeat an id and text one stays.
    """
    # A row is known by a key that is written down, as a second reading of ``docs`` may come in another order.
    rows, names = _plain(docs)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    groups = jaccard_join(rows.select("row", text.alias("text")), "row", "text", width=5, threshold=(80, 100))
    groups = materialize(groups.where("n_links > 0").select("row", F.col("component_id").alias("group")), "groups")
    linked = groups.join(rows.select("row", doc_id.alias("id")), "row")
    stays = linked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"].alias("row"))

    bare = rows.where(doc_id.isNotNull() & ~F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    bare = bare.select("row", doc_id.alias("id"), text.cast("string").alias("text"))
    stays = stays.select("row").unionByName(bare.groupBy("id", "text").agg(F.min("row").alias("row")).select("row"))
    dropped = groups.select("row").unionByName(bare.select("row")).join(stays, "row", "left_anti")
    dropped = materialize(dropped, "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return rows.join(dropped, "row", "left_anti").select(*names.values()).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text contains a benchmark item go; equal texts, known by half a SHA-256, go together."""
    rows, names = _plain(docs)
    rows = rows.withColumn("key", F.substring(F.unhex(F.sha2(F.col(names["text"]).cast("binary"), 256)), 1, 16))
    texts = rows.select("key", F.col(names["text"]).alias("text"))
    found = contaminated(texts, table(spark, sf_dir, "benchmark"), "key", "text", "item_id", "text").select("key").distinct()
    found = materialize(found, "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return rows.join(found, "key", "left_anti").select(*names.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    rows, names = _plain(docs)
    mixed = ordered_mix(rows, names["doc_id"], names["text"], names["source"])
    return mixed.select(*names.values()).toDF(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard."""
    return shard(docs, SHARD_BYTES, "doc_id", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The first stage is a trained classifier, and later ones order rows by hashes: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
