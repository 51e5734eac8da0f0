"""Names of several words, hydration, facets, bounds, runs over targets, errors inside answers, tables made if missing."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import druglabels, graph, hydration, ingestion, kgraph
from siltstone.sources import compounds, connectors
from siltstone.streaming import processors, state


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "Type-2 diabetes, type 2 DIABETES mellitus."), (2, None), (3, "diabetes"), (4, "")], "id long, t string")
    names = spark.createDataFrame([("type 2 diabetes",), ("Diabetes Mellitus",), ("DIABETES",), ("!!",), (None,), ("diabetes",)], "n string")
    got = {(r["id"], r["entity"]): r["times"] for r in graph.phrase_entities(docs, "id", "t", names, "n").collect()}
    assert got == {(1, "type 2 diabetes"): 2, (1, "diabetes mellitus"): 1, (1, "diabetes"): 2, (3, "diabetes"): 1}
    assert graph.phrase_entities(docs, "id", "t", names.where("false"), "n").count() == 0


def test_hydration_keeps_papers_without_journal_or_authors(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 99)], "chunk long, paper long")
    papers = spark.createDataFrame([(10, 5, "a"), (11, None, "b")], "paper long, journal long, title string")
    journals = spark.createDataFrame([(5, "J")], "journal long, jname string")
    links = spark.createDataFrame([(10, 2, 0), (10, 1, 1), (10, 2, 0), (10, 8, 2), (77, 1, 0)], "paper long, author long, pos long")
    authors = spark.createDataFrame([(1, "x"), (2, "y")], "author long, name string")
    got = {r["chunk"]: (r["title"], r["jname"], r["authors"]) for r in hydration.hydrated(chunks, papers, journals, links, authors, "paper", "journal", "author", "pos", "name").collect()}
    assert got == {1: ("a", "J", ["y", "x"]), 2: ("a", "J", ["y", "x"]), 3: ("b", None, [])}


def test_facets_count_parents_once(spark):
    found = spark.createDataFrame([(1, 4), (1, 2), (2, 3), (3, 1)], "doc long, place long")
    about = spark.createDataFrame([(1, "en"), (2, "en"), (3, None)], "doc long, lang string")
    assert {(r["value"], r["n"], r["first"]) for r in hydration.facets(found, "doc", "place", about, ["lang"]).collect()} == {("en", 2, 2), (None, 1, 1)}


def test_lists_with_conditions(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "a", 0), (2, "c", 0), (2, None, 1)], "k long, v string, ok int")
    got = {r["k"]: (r["good"], r["all"]) for r in hydration.distinct_lists(rows, "k", {"good": ("v", F.col("ok") == 1), "all": ("v", F.lit(True))}).collect()}
    assert got == {1: (["a", "b"], ["a", "b"]), 2: ([], ["c"])}


def test_target_run_queues_a_paper_once(spark):
    acts = spark.createDataFrame([("t", c, n) for n, c in enumerate("gfedcba")] + [("u", "g", 9), ("t", "g", 20)], "t string, c string, at long")
    papers = spark.createDataFrame([("g", 1), ("g", 1), ("f", 2), ("c", 3), ("a", 4), ("b", 5)], "c string, p long")
    log = spark.createDataFrame([(2,)], "p long")
    links, counts, queued = compounds.target_run(acts, papers, log, "t", "c", ["at"], "p")
    assert links.count() == 8
    assert {tuple(r) for r in counts.select("t", "n_compounds", "n_ids").collect()} == {("t", 7, 3), ("u", 1, 1)}
    assert sorted(r["p"] for r in queued.collect()) == [1, 3]


def test_pages_of_any_depth(spark):
    node = {"TOCHeading": "Mechanism of Action", "Information": [{"Value": {"StringWithMarkup": [{"String": "a text far below the top"}]}}]}
    for _ in range(15):
        node = {"TOCHeading": "Level", "Section": [node]}
    pages = spark.createDataFrame([(1, json.dumps(node)), (2, "{}"), (3, "no json"), (4, None)], "id long, raw string")
    assert [(r["id"], r["texts"]) for r in druglabels.page_sections(pages, "id", "raw").collect()] == [(1, ["a text far below the top"])]


def test_bounds_of_graph_requests(spark):
    long = "x" * (ingestion.MOST_CHARS + 1)
    rows = [("who", "a", ["c"] * 20, ["l"] * 200), ("who", "a", ["c"] * 21, []), ("who", "a", [long], []), ("who", "a", None, ["l"] * 201), ("wh", "a", [], []), ("who", "", [], []), (None, "a", [], [])]
    got = ingestion.checked_graph_request(spark.createDataFrame(rows, "q string, a string, c array<string>, l array<string>"), "q", "a", "c", "l")
    assert [r["problem"] for r in got.collect()] == [None, "chunks", "chunk length", "labels", "query length", "answer length", "query length"]
    asked = spark.createDataFrame([("who", 5, "full", ["user", "assistant"]), ("who", 5, "full", ["system"]), ("who", 5, "full", [None]), ("who", 5, "full", [])], "q string, k int, strategy string, roles array<string>")
    assert [r["problem"] for r in ingestion.checked_request(asked, "q", "k", roles="roles").collect()] == [None, "role", "role", None]


def test_errors_inside_answers_are_tried_again():
    answers, waits = iter([{"ERROR": "busy"}, {"ERROR": "busy"}, {"count": 3}]), []
    assert connectors.retried(lambda: next(answers), sleep=waits.append, refused=lambda a: a.get("ERROR")) == {"count": 3} and waits == [5.0, 10.0]
    with pytest.raises(ValueError, match="busy"):
        connectors.retried(lambda: {"ERROR": "busy"}, sleep=waits.append, refused=lambda a: a.get("ERROR"))


def test_tables_made_if_missing(spark):
    spark.sql("DROP TABLE IF EXISTS made_if_missing")
    assert ingestion.ensured(spark, "made_if_missing", "id long").count() == 0
    spark.sql("INSERT INTO made_if_missing VALUES (7)")
    again = ingestion.ensured(spark, "made_if_missing", "id long, sparse map<string, double>")
    assert again.columns == ["id", "sparse"] and [tuple(r) for r in again.collect()] == [(7, None)]
    spark.sql("DROP TABLE made_if_missing")


def test_queue_stream_over_restarts(spark, tmp_path):
    """Stale claims go back, illegal moves change nothing, final states stay, and a restart repeats nothing."""
    own = processors.with_state_store(spark)
    kind = "k string, ts timestamp, n long, action string"
    first = [("a", "2024-01-01 00:00:00", 1, "claim"), ("a", "2024-01-01 00:10:00", 2, "parse"), ("b", "2024-01-01 00:00:00", 3, "index"), ("b", "2024-01-01 00:01:00", 4, "claim"), ("c", "2024-01-01 00:01:00", 5, "claim")]
    later = [("a", "2024-01-01 00:20:00", 6, "index"), ("a", "2024-01-01 00:30:00", 7, "fail"), ("b", "2024-01-01 02:00:00", 8, "parse"), ("b", "2024-01-01 02:01:00", 9, "claim"), ("b", "2024-01-01 02:02:00", 10, "fail"), ("c", "2024-01-01 00:30:00", 11, "skip")]
    for part in (first, later, None):
        if part:
            spark.createDataFrame(part, "k string, ts string, n long, action string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(kind).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
        processors.run_available(processors.queue_stream(stream, "k", "ts", "n", "action", 3600), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r["n"]: (r["status"], r["retries"], r["moved"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) == 11
    assert [got[n] for n in (1, 2, 6, 7)] == [("fetching", 0, True), ("parsing", 0, True), ("indexed", 0, True), ("indexed", 0, False)]
    assert [got[n] for n in (3, 4, 8, 9, 10)] == [("queued", 0, False), ("fetching", 0, True), ("queued", 0, False), ("fetching", 0, True), ("error", 1, True)]
    assert got[11] == ("skipped", 0, True)


def test_slots_of_a_hot_key_over_ranges(spark):
    """A key with most rows lies in several ranges; every row is as a replay in one loop gives it."""
    rows = [("hot" if k % 10 < 7 else None if k % 10 == 7 else f"k{k % 5}", "acquire" if k * k % 7 in (1, 2) or k % 400 < 30 else "release", k) for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        events = spark.createDataFrame(rows, "k string, a string, id long")
        got = {r["id"]: (r["granted"], r["held"]) for r in state.slot_replay(events, "k", "a", "id", 3).collect()}
        assert state.slot_replay(events.where("false"), "k", "a", "id").count() == 0
        parts = events.repartitionByRange("k", "id").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    held, want = {}, {}
    for k, what, n in rows:
        before = held.get(k, 0)
        held[k] = min(before + 1, 3) if what == "acquire" else max(before - 1, 0)
        want[n] = (held[k] != before, held[k])
    assert parts > 3 and got == want


def test_answer_prose(spark):
    rows = ["One [1].\n\n\n\nTwo\t\t[2] three.\nThis is for INFORMATION only, ask.\n\n### Suggested questions\n1. why", "you might also want\nto know: x", "A follow-up questions list stays.", None, "Ok [1]"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(T.answer_prose(F.col("t"))).collect()] == ["One .\n\nTwo three.", "", "A follow-up questions list stays.", "", "Ok"]
    assert [r[0] is None for r in df.select(T.history_entry(F.col("t"))).collect()] == [False, True, False, True, True]


def test_evidence_by_index_or_id(spark):
    df = spark.createDataFrame([({1: 70, 2: 1}, [1, 70, 2, 9, 1]), ({}, [1]), ({1: 70}, None)], "m map<long,long>, c array<long>")
    assert [r[0] for r in df.select(kgraph.evidence(F.col("c"), F.col("m"))).collect()] == [[70, 1], [], []]
