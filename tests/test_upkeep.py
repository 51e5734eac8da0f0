"""Batches that come twice, compaction, bulk writes that fail, artefacts of changed tables and of two builders."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.sources import index_sink
from siltstone.sources.store import Tables
from siltstone.sources.versioned import VersionedTables
from siltstone.streaming import upkeep


def test_a_batch_twice_changes_nothing(spark, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}/t")
    members = spark.createDataFrame([(c, f"E{(c * k) % 7}") for c in range(30) for k in range(4)], "c long, e string")
    apply = upkeep.upkeep(tables, "c", "e", compact_every=100)
    for batch in range(3):
        apply(members.where(F.pmod("c", F.lit(3)) == batch), batch)
    want = sorted(map(tuple, graph.weighted(graph.entity_rows(members, "c", "e")).collect()))
    assert sorted(map(tuple, upkeep.edges(tables).collect())) == want
    before = tables.last()
    apply(members.where("c % 3 = 1"), 1)
    assert tables.last() == before
    apply(members.where("c % 3 = 1"), 9)  # the same sources under another number
    assert sorted(map(tuple, upkeep.edges(tables).collect())) == want
    files = tables.at().files("provenance")
    assert max(map(len, files.values())) > 1
    after = tables.compact("provenance", 1)
    compacted = tables.at(after).files("provenance")
    assert all(len(n) == 1 for n in compacted.values()) and all(compacted[b] == n for b, n in files.items() if len(n) == 1)
    assert sorted(map(tuple, upkeep.edges(tables).collect())) == want and tables.compact("provenance", 1) == after


def test_a_failed_bulk_write_leaves_the_index(spark, tmp_path):
    path, schema = f"file://{tmp_path}/index", "id long, v string, n long"
    write = lambda rows: index_sink.bulk_write(spark.createDataFrame(rows, schema).repartition(3), path)
    found = lambda: sorted(map(tuple, index_sink.read_index(spark, path, schema, "id", "n").collect()))
    assert found() == []
    write([(k, "old", 5) for k in range(10)] + [(3, "older", 1)])
    assert found() == [(k, "old", 5) for k in range(10)]
    bad = spark.range(0, 40, numPartitions=4).select("id", F.lit("bad").alias("v"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        index_sink.bulk_write(bad, path)
    assert found() == [(k, "old", 5) for k in range(10)] and len(index_sink.commits(spark, path)) == 1
    write([(3, "new", 0), (99, "new", 0)])
    assert found() == [(k, "old" if k != 3 else "new", 5 if k != 3 else 0) for k in range(10)] + [(99, "new", 0)]
    write([])
    assert len(found()) == 11


def test_a_changed_table_has_other_artefacts(spark, tmp_path):
    spark.range(5).withColumn("w", F.lit(1)).write.parquet(str(tmp_path / "edges.parquet"))
    build = lambda t: t.kept("sum", lambda: t("edges").agg(F.sum("w").alias("s"), F.count("*").alias("n")))
    assert tuple(build(Tables(spark, str(tmp_path))).first()) == (5, 5)
    time.sleep(0.05)
    spark.range(5).withColumn("w", F.lit(2)).write.mode("overwrite").parquet(str(tmp_path / "edges.parquet"))
    assert tuple(build(Tables(spark, str(tmp_path))).first()) == (10, 5)


def test_two_builders_end_with_one_artefact(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "a.parquet"))
    t, built, got = Tables(spark, str(tmp_path)), [], []

    def work():
        df = t.kept("both", lambda: built.append(1) or t("a").withColumn("r", F.rand()))
        got.append((df.inputFiles(), sorted(map(tuple, df.collect()))))

    both = [threading.Thread(target=work) for _ in range(2)]
    for b in both:
        b.start()
    for b in both:
        b.join()
    assert len(got) == 2 and got[0] == got[1] and len(got[0][1]) == 50
    assert t.kept("both", lambda: 1 / 0).count() == 50
