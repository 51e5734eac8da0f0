import pytest
from pyspark.sql import functions as F

from siltstone.operators import answer, chunking, fusion, graph, kgraph, upserts, vectors
from siltstone.sources import records, tables
from siltstone.streaming import state


@pytest.mark.parametrize(
    "raw,n,cut",
    [('{"relations":[{"subject":"a","predicate":"b","object":"c"}]}', 1, False), ('```json\n{"relations":[]}\n```', 0, False), ('{"relations":[{"subject":"a","predicate":"b","object":"c"},{"subj', 1, True),
     ("no json", 0, False), ("", 0, False), (None, 0, False), ('{"relations":{"a":1}}', 0, False), ('{"relations":[{"subject":"a}","predicate":"\\"{","object":"c"}, 5, {"subject":"b","x":1}', 2, True)],
)
def test_salvage(spark, raw, n, cut):
    got = spark.createDataFrame([(raw,)], "r string").select(kgraph.salvage(F.col("r")).alias("s")).first()["s"]
    assert (len(got["relations"]), got["truncated"]) == (n, cut)


@pytest.mark.parametrize("pool,top_k,compat,want", [(0, 20, False, 5), (60, 20, False, 6), (250, 20, False, 20), (100, 4, False, 4), (100, 4, True, 5), (3, 1, True, 5)])
def test_target(spark, pool, top_k, compat, want):
    assert spark.range(1).select(fusion.target(F.lit(pool), top_k, compat=compat)).first()[0] == want


def test_snapped_windows_cover_the_text(spark):
    text = ("word " * 30 + "end. ") * 60
    rows = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(chunking.snapped_windows(F.col("t")).alias("w")).collect()
    w = rows[0]["w"]
    assert w[0]["start"] == 0 and w[-1]["end"] == len(text) and all(b["start"] == a["end"] - 512 for a, b in zip(w, w[1:]))
    assert all(x["end"] - x["start"] <= 2048 for x in w) and all(text[: x["end"]].endswith(". ") for x in w[:-1])
    assert [x["text"] for x in rows[1]["w"]] == ["short"] and rows[2]["w"] == []


def test_pagerank_mass_and_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 3, [1]), ("b", "c", 2, [2]), ("x", "y", 5, [3]), ("a", "z", 1, [4])], "a string, b string, weight long, sources array<long>")
    ranks = {r["node"]: r["rank"] for r in graph.personalised_pagerank(graph.symmetric(edges), ["A", "none"], 12, tolerance=0).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and "z" not in ranks and ranks["x"] < ranks["a"]
    assert graph.personalised_pagerank(graph.symmetric(edges), ["none"], 2).count() == 0


def test_pagerank_stops_and_fails(spark):
    edges = graph.symmetric(spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("a", "c", 2)], "a string, b string, weight long"))
    ways = [sorted((r["node"], round(r["rank"], 9)) for r in graph.personalised_pagerank(edges, ["a"], 300, one_task_edges=k).collect()) for k in (0, 100)]
    assert ways[0] == ways[1] and abs(sum(r for _, r in ways[0]) - 1) < 1e-6
    lone = graph.symmetric(spark.createDataFrame([("a", "b", 3)], "a string, b string, weight long"))
    with pytest.raises(Exception, match="still move"):
        graph.personalised_pagerank(lone, ["a"], 2).collect()


def test_pagerank_by_blocks(spark):
    """A hub with more edges than a unit, nodes without out-edges, repeated edges and null ends: all ways give the same ranks."""
    rows = [("hub", f"n{k}", 1 + k % 3) for k in range(90)] + [(f"n{k}", f"n{k * 7 % 90}", 2) for k in range(60)] + [(f"n{k}", "hub", 1) for k in range(0, 90, 9)]
    rows += [("n1", "n7", 2), (None, "n1", 4), ("n2", None, 4)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    ranked = lambda **how: {r["node"]: r["rank"] for r in graph.personalised_pagerank(edges, ["hub", "N3", "none"], 9, tolerance=0, **how).collect()}
    one = ranked()
    assert len(one) == 91 and abs(sum(one.values()) - 1) < 1e-9
    for how in ({"block_nodes": 10, "unit_edges": 20}, {"block_nodes": 1000, "unit_edges": 1000}, {"block_nodes": 1, "unit_edges": 1}):
        other = ranked(one_task_edges=0, **how)
        assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)
    assert graph.personalised_pagerank(edges, ["none"], 2, one_task_edges=0).count() == 0
    assert graph.personalised_pagerank(edges.where("false"), ["hub"], 2).count() == 0


def test_graph_increment_is_idempotent(spark):
    m = spark.createDataFrame([(1, "A"), (1, "b"), (1, "B"), (2, "a"), (2, "b"), (2, "c")], "chunk long, e string")
    base = graph.entity_rows(m.where("chunk = 1"), "chunk", "e")
    once = graph.increment(base, m, "chunk", "e")
    twice = graph.increment(once, m, "chunk", "e")
    rows = lambda d: sorted((r["a"], r["b"], r["weight"]) for r in graph.weighted(d).collect())
    assert rows(once) == rows(twice) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_prefix_trap_of_paths(spark):
    terms = spark.createDataFrame([("r", ["C1.2"]), ("in", ["C1.2.7"]), ("out", ["C1.20"]), ("two", ["Z", "C1.2.9.1"])], "ui string, paths array<string>")
    got = graph.descendants(terms, terms.where("ui = 'r'"), "ui", "paths").collect()
    assert sorted(r["ui"] for r in got) == ["in", "two"]


def test_cache_and_slots(spark):
    ev = spark.createDataFrame([(1, 0.0, 1), (1, 59.0, 2), (1, 60.0, 3), (1, 119.0, 4), (2, 5.0, 5)], "k long, s double, id long")
    assert {r["id"]: r["hit"] for r in state.cache_replay(ev, "k", "s", "id").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    acts = ["acquire"] * 4 + ["release", "acquire", "acquire"]
    sl = spark.createDataFrame([(1, a, i) for i, a in enumerate(acts)] + [(2, "release", 9)], "k long, a string, id long")
    got = {r["id"]: (r["granted"], r["held"]) for r in state.slot_replay(sl, "k", "a", "id").collect()}
    assert got[3] == (False, 3) and got[5] == (True, 3) and got[6] == (False, 3) and got[9] == (False, 0)


def test_slot_stream(spark, tmp_path):
    acts = ["acquire", "acquire", "acquire", "acquire", "release"]
    spark.createDataFrame([(1, a) for a in acts], "k long, a string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, a string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the timeout keeps batches coming
    q = state.slot_stream(stream, "k", "a").writeStream.format("memory").queryName("slots").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    q.stop()
    assert [r["granted"] for r in spark.table("slots").collect()].count(False) == 1


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k long, v string, n int")
    assert sorted(tuple(r) for r in upserts.upsert(old, new, ["k"], "n").collect()) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    assert sorted(r["v"] for r in upserts.insert_ignore(old, new, ["k"], "v").collect()) == ["a", "b", "d"]
    once = upserts.insert_ignore(old, new, ["k"], "v")
    assert upserts.insert_ignore(once, new, ["k"], "v").count() == 3


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    upserts.save_snapshot(df, str(tmp_path / "s"), ["k", "v"])
    assert upserts.load_snapshot(df, str(tmp_path / "s"), ["k", "v"]).count() == 2
    changed = df.withColumn("v", F.lit("x"))
    assert upserts.load_snapshot(changed, str(tmp_path / "s"), ["k", "v"]) is None


def test_citations(spark):
    a = spark.createDataFrame([(1, "Muscle proteins grow [1]. Nothing shared here [2]. Bad [7].")], "answer long, response string")
    c = spark.createDataFrame([(1, 1, "muscle proteins grow fast"), (1, 2, "other topic entirely")], "answer long, number long, text string")
    got = sorted((r["citation"], r["severity"]) for r in answer.verify(a, c, "answer", "response", "number", "text").collect())
    assert got == [(2, "weak"), (7, "invalid")]


def test_knowledge_graph(spark):
    rel = spark.createDataFrame([(1, 1, "Leucine", "activates", "mTOR", [1]), (1, 2, "leucine", "Activates", "MTOR", [2]), (1, 3, "cell", "has", "mTOR", [1]), (1, 4, "Ghost", "kills", "mTOR", [1]), (1, 5, "mTOR", "is", "Leucine", [3])], "g long, at long, subject string, predicate string, object string, citations array<long>")
    ans = spark.createDataFrame([(1, "Leucine activates mTOR in the cell")], "g long, answer string")
    nodes = kgraph.nodes(rel, ans, "g", "at")
    assert sorted((r["id"], r["label"]) for r in nodes.collect()) == [("leucine", "Leucine"), ("mtor", "mTOR")]
    edges = kgraph.edges(rel, nodes, "g", "at").collect()
    assert [(e["source"], e["predicate"], e["target"], e["citations"]) for e in edges] == [("leucine", "activates", "mtor", [1, 2])]


def test_records(spark):
    xml = "<S><PubmedArticle><PMID>12</PMID><ArticleTitle>A <i>b</i></ArticleTitle><Abstract><AbstractText Label='X'>y</AbstractText><AbstractText>z</AbstractText></Abstract><PubDate><Year>2021</Year><Month>Jan</Month><Day>5</Day></PubDate></PubmedArticle><PubmedArticle><PMID>no</PMID></PubmedArticle></S>"
    got = records.articles(spark.createDataFrame([(xml,)], "x string"), "x").collect()
    assert [(r["pmid"], r["title"], r["abstract"], r["pub_date"]) for r in got] == [("12", "A b", "X: y z", "2021-01-05")]
    jats = "<article><body><sec sec-type='methods'><title>M</title><p>one <xref>1</xref> two</p><sec><title>Results</title><p>three</p></sec></sec></body></article>"
    secs = records.sections(spark.createDataFrame([(1, jats), (2, "<html/>"), (3, None)], "id long, x string"), "id", "x").collect()
    assert [(s["section_type"], s["content"]) for s in secs] == [("methods", "one two"), ("results", "three")]


def test_windows_split(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([(d + dt.timedelta(days=k), 4) for k in range(8)], "day date, n long")
    got = tables.split_windows(daily, 9)
    assert sum(n for _, _, n, _ in got) == 32 and all(n <= 9 and not cut for *_, n, cut in got)
    assert [(n, cut) for _, _, n, cut in tables.split_windows(daily, 1)] == [(1, True)] * 8 and tables.split_windows(daily.where("false"), 1) == []


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 4.0])], "id long, v array<float>")
    got = vectors.dense_topk(df.where("id <> 2"), [0.6, 0.8], 2, "id", "v").collect()
    assert [r["id"] for r in got] == [4, 1] and abs(got[0]["similarity"] - 1) < 1e-6
    enc = vectors.encode(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda ts: [[float(len(t))] for t in ts])
    assert [r["embedding"] for r in enc.collect()] == [[2.0], [0.0]]
