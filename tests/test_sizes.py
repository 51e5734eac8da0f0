"""Cases that show only in larger tables."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.operators import druglabels, graph, keys, kgraph, lexical
from siltstone.plans import catalogue
from siltstone.sources import tables
from siltstone.sources.store import Tables
from siltstone.streaming import processors


def test_a_job_ends_within_the_second(spark):
    asked = spark.createDataFrame([(1, 7, "2024-01-11 00:00:00"), (2, 7, "2024-01-11 00:00:00.4"), (3, 8, "2024-01-01 00:00:00")], "event long, job long, at string").withColumn("at", F.to_timestamp("at"))
    jobs = spark.createDataFrame([(7, "2024-01-01 00:00:00", "pending")], "job long, created string, status string").withColumn("created", F.to_timestamp("created"))
    assert {r["event"]: r["code"] for r in keys.polled(asked, jobs, "job", "at", 864000).collect()} == {1: 200, 2: 404, 3: 404}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").count("Exchange ")


def test_postings_exchange_texts_only(spark):
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, None, ""), (3, "A c", "a a")], "id long, t string, u string")
    made = lexical.postings(docs, "id", {"t": lexical.tokens(F.col("t")), "u": lexical.tokens(F.col("u"))})
    assert exchanges(made) == 1
    got = sorted((r["doc"], r["field"], r["term"], r["tf"], r["len"]) for r in made.collect())
    assert got == [(1, "t", "a", 1, 3), (1, "t", "b", 2, 3), (1, "u", "x", 1, 1), (3, "t", "a", 1, 2), (3, "t", "c", 1, 2), (3, "u", "a", 2, 2)]


def test_a_task_gets_as_many_texts_as_it_can_hold(spark):
    docs = spark.range(2000).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert tables.text_tasks(docs) == spark.sparkContext.defaultParallelism and tables.text_tasks(docs, 10_000) == 20
    assert tables.dealt(docs, "id", 100).rdd.getNumPartitions() == 20


def test_pairs_and_boosts_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(tables.row_tasks, "__defaults__", (100,))
    monkeypatch.setattr(tables.dealt, "__defaults__", (100,))
    members = spark.range(1000).select((F.col("id") % 250).alias("c"), F.concat(F.lit("E"), F.col("id") % 7).alias("e"))
    found = graph.pairs(members, "c", "e")
    assert "hashpartitioning(g" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    ranks = spark.createDataFrame([("e1", 0.5), ("e3", 0.25)], "node string, rank double")
    boosts = graph.chunk_boosts(members, ranks, "c", "e")
    assert exchanges(boosts) == 1
    names = {c: {f"e{k % 7}" for k in (c, c + 250, c + 500, c + 750)} for c in range(250)}
    held = {c: ("e1" in n) * 0.5 + ("e3" in n) * 0.25 for c, n in names.items() if n & {"e1", "e3"}}
    assert {r["chunk"]: r["boost"] for r in boosts.collect()} == held


def test_both_directions_come_from_one_row(spark):
    edges = graph.symmetric(spark.createDataFrame([("a", "b", 3), ("c", "c", 2), ("a", "d", 1)], "a string, b string, weight long"))
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 3), ("b", "a", 3), ("c", "c", 2)]
    assert "Union" not in edges._jdf.queryExecution().executedPlan().toString()


def test_few_rows_use_every_core(spark):
    assert tables.row_tasks(spark.range(10)) == spark.sparkContext.defaultParallelism


def test_line_weights_are_dealt_by_bytes(spark, sf):
    made = catalogue.line_weights(Tables(spark, sf))
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString() and exchanges(made) == 1


def test_paragraphs_of_a_document_are_numbered_where_they_lie(spark, sf):
    plan = catalogue.append_chunks(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_a_session_is_made_once_and_dealt_by_its_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tables.row_tasks, "__defaults__", (100,))
    monkeypatch.setattr(tables.dealt_as, "__defaults__", (100,))
    plan = catalogue.QUERIES["session_round_trip"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [graph" in plan and ", 60" in plan and plan.count("RepartitionByExpression") == 7


def test_a_text_without_an_edge_is_found(spark):
    e = "array<struct<source:string,predicate:string,target:string,citations:array<bigint>>>"
    text = '{"edges": [{"source": "a", "predicate": "p", "target": "b", "citations": [1]}]}'
    rows = spark.createDataFrame([(1, text, [("a", "p", "b", [1])]), (2, text, [("a", "p", "b", [1]), ("b", "p", "a", [2])]), (3, "{", [("a", "p", "b", [1])]), (4, text, None), (5, text, [("a", "p", "b", [2])])], f"g long, payload string, edges {e}")
    assert [r["g"] for r in kgraph.whole(rows, "g").collect()] == [1]


def test_names_of_a_graph_by_sorted_lists(spark):
    rel = spark.createDataFrame([(1, 2, "Red-x", "Blue"), (1, 1, "red x", " "), (1, 3, "RED X", "Far"), (2, 1, None, "Blue")], "g long, at long, subject string, object string")
    said = spark.createDataFrame([(1, "red x, red-x and blue"), (2, "none")], "g long, answer string")
    kinds = spark.createDataFrame([(1, "red x", "DRUG"), (1, "red x", "GENE"), (1, "blue", None)], "g long, label_lc string, type string")
    got = sorted(map(tuple, kgraph.nodes(rel, said, "g", "at", kinds).select("g", "id", "label", "label_lc", "type").collect()))
    assert got == [(1, "blue", "Blue", "blue", "OTHER"), (1, "red-x", "red x", "red x", "DRUG"), (1, "red-x", "red x", "red-x", "DRUG")]


def test_a_parsed_text_is_parsed_once(spark, sf):
    for name, parser in (("article_records", "from_xml"), ("article_split", "from_xml")):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(parser) == 1 and "RepartitionByExpression [_set" in plan


def test_an_unread_text_is_a_row(spark):
    rows = tables.parsed(spark.createDataFrame([(1, '{"a": 2}'), (2, None)], "id long, t string"), "p", F.from_json("t", "a int"))
    assert sorted((r["id"], r["p"] and r["p"]["a"]) for r in rows.collect()) == [(1, 2), (2, None)]
    assert [r["id"] for r in rows.where("p.a > 1").collect()] == [1]


def test_sections_of_a_page_are_parsed_once_and_dealt(spark):
    pages = spark.createDataFrame([(1, '{"TOCHeading": "MOA", "Section": [{"TOCHeading": "The MOA", "Information": [{"Value": {"StringWithMarkup": [{"String": "a text of some length"}, {"String": "short"}]}}]}]}'), (2, "{"), (3, None)], "id long, raw string").coalesce(1)
    found = druglabels.page_sections(pages, "id", "raw")
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "mechanism", ["a text of some length"])]


class Held:
    """A state of one value that counts how often it is asked."""

    def __init__(self, value=None):
        self.value, self.asked = value, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def exists(self):
        self.asked += 1
        return self.value is not None

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        pass


def test_a_key_of_a_stream_is_rows_and_reads_its_state_once():
    event = Row("k", "_us", "n", "what")
    rows = [event(1, 9_000_000, 3, "claim"), event(1, 2_000_000, 1, "claim"), event(1, 2_000_000, 2, "fail")]
    for made, last in ((processors.KeepAlive("k", "ts", "n", 3.0), 2), (processors.KeyCache("k", "ts", "n", "what", 60), True), (processors.WorkQueue("k", "ts", "n", "what"), True)):
        held = Held()
        made.init(held)
        got = [r.asDict() for r in made.handleInputRows((1,), iter(rows), None)]
        assert [r["n"] for r in got] == [1, 2, 3] and list(got[-1].values())[-1] == last and held.asked == 1


def test_hydration_is_dealt_by_the_links_of_papers(spark, sf, monkeypatch):
    monkeypatch.setattr(tables.row_tasks, "__defaults__", (100,))
    monkeypatch.setattr(tables.dealt_as, "__defaults__", (100,))
    plan = catalogue.QUERIES["hydrate_journals"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [l_orderkey") == 5 and ", 60" in plan
