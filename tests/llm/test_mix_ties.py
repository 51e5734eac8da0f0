"""Rows that share id and size are as many documents: targets are met to one of them, in the query and in the pipeline."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm.mixing import mix, ordered_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    other = [(k, "w " * (3 + k % 5), "en", "B", 1) for k in range(100)] + [(k, "v " * 30, "en", "C", 1) for k in range(200, 240)]
    null = [(None, f"{k} " + "n " * 9, "en", "A", 1) for k in range(300)]
    repeated = [(7, "r " * 10, "en", "A", 1) for _ in range(300)]
    mixed = [(None, "n " * 10, "en", "A", 1) for _ in range(150)] + [(k, "m " * (1 + k % 20), "en", "A", 1) for k in range(1000, 1150)]
    return {"null": null + other, "repeated": repeated + other, "mixed": mixed + other}


@pytest.mark.parametrize("name", ["null", "repeated", "mixed"])
def test_targets_are_met(spark, name):
    rows = tables()[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    placed = mix(df).placed().collect()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    source = {"A": [r for r in rows if r[3] == "A"]}
    assert len(placed) == len(rows) and len(source["A"]) == 300
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    by = {size: s for s, size in sizes.items()}
    for r in placed:
        s = by[r["source_size"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["mix_places"]) == r["copies"]
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    # A rerun over other partitions agrees on what can be told apart.
    again = mix(df.repartition(5)).placed().collect()
    assert collections.Counter((r["doc_id"] if "doc_id" in r else r["id"], r["size"], r["taken"]) for r in placed) == collections.Counter(
        (r["doc_id"] if "doc_id" in r else r["id"], r["size"], r["taken"]) for r in again
    )


@pytest.mark.parametrize("name", ["null", "repeated"])
def test_the_order_holds_what_the_plan_takes(spark, name):
    df = spark.createDataFrame(tables()[name], SCHEMA).withColumn("row", F.lit("clash")).withColumn("mix_pass", F.lit("clash"))
    planned = collections.Counter()
    for r in mix(df).planned().collect():
        planned[r["source"]] += r["taken"]
    for mixed in (ordered_mix(df), mix(df).ordered(df)):
        got = collections.Counter()
        for r in mixed.collect():
            assert r["row"] == "clash" and r["mix_pass"] in (1, 2, 3)
            got[r["source"]] += len(r["text"].split())
        assert got == planned


def test_the_pipeline_stage(spark):
    rows = tables()["null"]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = sum(r["taken"] for r in mix(df).planned().collect())
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and sum(len(r["text"].split()) for r in mixed.collect()) == planned
