"""Registered queries over tables with versions: claims of a queue, commits of several tables, graph upkeep, bulk writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources import index_sink
from siltstone.sources.store import shared_folder
from siltstone.sources.versioned import VersionedTables
from siltstone.streaming import state, upkeep


def versioned(t) -> VersionedTables:
    return VersionedTables(t.spark, f"{shared_folder(t.spark)}/siltstone/versioned/{uuid.uuid4().hex}")


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id),
q AS (SELECT user_id, row_number() OVER (ORDER BY ts, user_id) AS place FROM s WHERE status = 'click')
SELECT user_id, CASE WHEN place <= 40 THEN 'fetching' ELSE status END AS status, CASE WHEN place <= 20 THEN 'first' WHEN place <= 40 THEN 'second' END AS claimed_by FROM s LEFT JOIN q USING (user_id)""")
def queue_claims(t):
    """The queue after two claimers have taken twenty waiting keys each."""
    tables = versioned(t)
    states = state.latest_state(t("events"), "user_id", "event_type", ["ts", "event_id"]).withColumn("claimed_by", F.lit(None).cast("string"))
    tables.commit(lambda _: {"queue": states}, {"queue": ["user_id"]})
    for claimer in ("first", "second"):
        tables.claim("queue", "status", "click", "fetching", ["ts", "user_id"], 20, claimer)
    return tables.at().read("queue").select("user_id", "status", "claimed_by")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'revised' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 0),
l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS part FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 7 = 0)
SELECT o_orderkey, any_value(status) AS status, count(part) AS links, CAST(coalesce(sum(part), 0) AS BIGINT) AS parts FROM o LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def merge_commit(t):
    """Papers and their links in one version: the even ones, then every seventh revised or added."""
    tables = versioned(t)
    papers, links = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    keys = {"papers": ["o_orderkey"], "links": ["l_orderkey", "l_linenumber"]}
    tables.commit(lambda _: {"papers": papers.where("o_orderkey % 2 = 0"), "links": links.where("l_orderkey % 2 = 0")}, keys)
    sevenths = {"papers": papers.where("o_orderkey % 7 = 0").withColumn("status", F.lit("revised")), "links": links.where("l_orderkey % 7 = 0").withColumn("part", F.col("part") + 1)}
    tables.commit(lambda _: sevenths)
    now = tables.at()
    of = now.read("links").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("part").alias("links"), F.sum("part").alias("parts"))
    return now.read("papers").join(of, "o_orderkey", "left").select("o_orderkey", "status", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("WITH m AS (SELECT DISTINCT l_orderkey AS g, lower(p_brand) AS e FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.e AS a, y.e AS b, count(*) AS weight FROM m x JOIN m y ON x.g = y.g AND x.e < y.e GROUP BY ALL")
def graph_stream(t):
    """The graph of brands after three arrivals of orders, of which one is delivered again and one comes again as another batch."""
    members = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk"), F.col("p_brand").alias("entity"))
    folder, tables = f"{shared_folder(t.spark)}/siltstone/streams/{uuid.uuid4().hex}", versioned(t)
    apply = upkeep.upkeep(tables, "chunk", "entity", compact_every=2)
    for k in range(3):
        members.where(F.pmod("chunk", F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in")
        arriving = t.spark.readStream.schema(members.schema).parquet(f"{folder}/in")
        arriving.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    again = members.where(F.pmod("chunk", F.lit(3)) == 1)
    apply(again, 1)
    apply(again, 7)
    return upkeep.edges(tables)


@query("SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END, event_id)) AS event_type, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) AS run FROM events GROUP BY user_id")
def bulk_index(t):
    """Three bulk writes to an index, of which a later one wins for its keys."""
    path = f"file://{folder}" if "://" not in (folder := f"{shared_folder(t.spark)}/siltstone/index/{uuid.uuid4().hex}") else folder
    run = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 1).otherwise(0)
    rows = t("events").select("user_id", "event_id", "event_type", run.alias("run"))
    for k in range(3):
        index_sink.bulk_write(rows.where(F.col("run") == k), path)
    return index_sink.read_index(t.spark, path, rows.schema, "user_id", "event_id").select("user_id", "event_type", "run")
