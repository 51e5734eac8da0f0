"""Registered queries of what results are shown with, of names, bounds, runs over targets and the work queue as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, druglabels, fusion, graph, hydration, ingestion, kgraph, lexical
from siltstone.plans.catalogue import BM25, TERMS, corpus
from siltstone.plans.registry import joined, longs, md5, query, r6
from siltstone.plans.stream_queries import arrived
from siltstone.sources import compounds
from siltstone.streaming import processors

# Orders are papers, their lines chunks and links to authors, customers with money journals, suppliers with money authors.


@query("""WITH a AS (SELECT l_orderkey, string_agg(s_name, '|' ORDER BY l_linenumber, l_suppkey) AS authors FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_orderstatus AS status, c_name AS journal, coalesce(authors, '') AS authors FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN a USING (l_orderkey) WHERE l_returnflag = 'R'""")
def hydrate_journals(t):
    """Chunks with their paper, its journal and authors, where either may be missing."""
    chunks = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    papers = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderstatus").alias("status"))
    journals = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("journal"))
    links = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("at"))
    authors = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    found = hydration.hydrated(chunks, papers, journals, links, authors, "l_orderkey", "o_custkey", "l_suppkey", "at", "s_name")
    return found.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "status", "journal", joined("authors", "|").alias("authors"))


@query(f"""WITH {BM25}, pl AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS place FROM sc), top AS (SELECT * FROM pl WHERE place <= 100), h AS (SELECT place, lang, source FROM top JOIN documents ON doc_id = doc)
SELECT 'lang' AS field, lang AS value, count(*) AS n, min(place) AS first FROM h GROUP BY ALL UNION ALL SELECT 'source', source, count(*), min(place) FROM h GROUP BY ALL""")
def result_facets(t):
    """Facets of the documents of a search's first hundred, each hit standing for several chunks."""
    found = fusion.ranked(lexical.search(corpus(t), TERMS, 100), "doc", "score", "place")
    chunks = found.select("doc", F.explode(F.array("place", F.col("place") + 100)).alias("place"))
    about = t("documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    return hydration.facets(chunks, "doc", "place", about, ["lang", "source"]).withColumn("first", F.col("first").cast("long"))


@query("""SELECT l_orderkey, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FILTER (WHERE l_returnflag <> 'N'), '') AS brands, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (WHERE p_size > 25), '') AS types
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def conditional_lists(t):
    rows = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    found = hydration.distinct_lists(rows, "l_orderkey", {"brands": ("p_brand", F.col("l_returnflag") != "N"), "types": ("p_type", F.col("p_size") > 25)})
    return found.select("l_orderkey", joined("brands").alias("brands"), joined("types").alias("types"))


@query(f"WITH {BM25} SELECT doc, round(score, 6) AS score FROM sc JOIN documents ON doc_id = doc WHERE list_has_any([lang, source], ['fr', 'src3'])")
def bm25_any_of(t):
    """A filter on an array field: any of its values is wanted."""
    tags = F.array("lang", "source")
    allowed = t("documents").where(F.arrays_overlap(tags, F.array(F.lit("fr"), F.lit("src3")))).select(F.col("doc_id").alias("doc"))
    return lexical.search(corpus(t), TERMS, allowed=allowed).select("doc", r6("score").alias("score"))


@query(f"WITH {BM25}, pl AS (SELECT doc, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS place FROM sc) SELECT doc, place, row_number() OVER (ORDER BY floor(score) DESC, place) AS shown FROM pl WHERE place <= 100")
def shown_order(t):
    """A result page by a coarse score: equal scores keep the order that they had."""
    found = lexical.search(corpus(t), TERMS, 100)
    placed = found.join(fusion.ranked(found, "doc", "score", "place"), "doc").withColumn("relevance", F.floor("score"))
    return fusion.shown_order(placed, "relevance", "place").select("doc", *longs("place", "shown"))


# Names of two and three words: the beginnings of the benchmark's texts.
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""WITH b AS (SELECT {_WORDS} AS w FROM benchmark), n AS (SELECT DISTINCT array_to_string(w[1:2], ' ') AS e FROM b WHERE len(w) >= 2 UNION SELECT array_to_string(w[1:3], ' ') FROM b WHERE len(w) >= 3),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), r AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS e FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d)
SELECT doc_id, e AS entity, count(*) AS times FROM r JOIN n USING (e) GROUP BY ALL""")
def phrase_entities(t):
    words = lexical.tokens(F.col("text"))
    first = lambda n: t("benchmark").where(F.size(words) >= n).select(F.initcap(F.array_join(F.slice(words, 1, n), " - ")).alias("name"))
    return graph.phrase_entities(t("documents"), "doc_id", "text", first(2).unionByName(first(3)), "name")


# Requests


@query("""SELECT conv_id, CASE WHEN length(any_value(q)) NOT BETWEEN 3 AND 2000 THEN 'query length' WHEN max(r) > 0 THEN 'role' END AS problem
FROM (SELECT conv_id, first_value(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS q, CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE 1 END AS r FROM conversations) GROUP BY 1""")
def request_roles(t):
    """Conversations as requests: the first turn asks, the roles of all are checked."""
    turns = t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.collect_list(F.coalesce("role", F.lit(""))).alias("roles"))
    rows = turns.withColumn("k", F.lit(20)).withColumn("strategy", F.lit("full"))
    return ingestion.checked_request(rows, "q", "k", roles="roles").select("conv_id", "problem")


@query("""WITH p AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'all' ELSE p_brand END AS p_brand, count(*) AS n FROM part GROUP BY 1), o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'brand' AS kind, p_brand AS id, CASE WHEN n > 200 THEN 'labels' END AS problem FROM p
UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), CASE WHEN o_custkey % 11 = 0 THEN 'answer length' WHEN n > 20 THEN 'chunks' WHEN o_custkey % 7 = 0 THEN 'chunk length' END FROM o""")
def graph_requests(t):
    """Brands, and a fifth of the parts together, ask with their parts as labels, customers with their orders as chunks, some of which are too long."""
    none = F.array().cast("array<string>")
    brands = t("part").groupBy(F.when(F.col("p_size") % 5 == 0, "all").otherwise(F.col("p_brand")).alias("id")).agg(F.min("p_name").alias("q"), F.max("p_type").alias("a"), F.collect_list("p_name").alias("labels")).select(F.lit("brand").alias("kind"), "id", "q", "a", none.alias("chunks"), "labels")
    text = F.when(F.col("o_custkey") % 7 == 0, F.repeat(F.lit("x"), F.lit(ingestion.MOST_CHARS + 1))).otherwise("x")
    held = t("orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    customers = held.select(F.lit("customer").alias("kind"), F.col("o_custkey").cast("string").alias("id"), F.lit("who").alias("q"), F.when(F.col("o_custkey") % 11 == 0, "").otherwise("a").alias("a"), F.array_repeat(text, F.col("n")).alias("chunks"), none.alias("labels"))
    return ingestion.checked_graph_request(brands.unionByName(customers), "q", "a", "chunks", "labels").select("kind", "id", "problem")


@query("SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER w, '')) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def history_prompt(t):
    """The twelve turns before each, as a prompt takes them."""
    return answer.recent(t("conversations"), "conv_id", "turn", "text", 12).select("conv_id", "turn", md5(F.array_join("history", "\n")).alias("h"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(h) > 5 THEN md5(h) END AS h FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS h FROM conversations WHERE role = 'assistant')""")
def history_prose(t):
    """Answers end in markers, a notice and further questions, which are gone again."""
    more = F.when(F.col("turn") % 4 == 1, "**Follow-up questions:**\n- why?").when(F.col("turn") % 4 == 2, "## You might also want to know\nwhy").otherwise("Related  questions: why?")
    dirty = F.concat("text", F.lit(" [3][12]\nThis is for information only, please ask.\n\n\n"), more)
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", md5(T.history_entry(dirty)).alias("h"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS id FROM lineitem GROUP BY ALL), c AS (SELECT k, unnest([2, -7, max(id), 1, 2]) AS x, unnest([1, 2, 3, 4, 5]) AS p FROM m GROUP BY k),
r AS (SELECT c.k, p, coalesce(m.id, CASE WHEN EXISTS (SELECT 1 FROM m o WHERE o.k = c.k AND o.id = x) THEN x END) AS id FROM c LEFT JOIN m ON m.k = c.k AND m.n = x),
s AS (SELECT k, id, min(p) AS p FROM r WHERE id IS NOT NULL GROUP BY ALL)
SELECT d.k AS l_orderkey, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY p), '') AS ids FROM (SELECT DISTINCT k FROM m) d LEFT JOIN s USING (k) GROUP BY d.k""")
def citation_ids(t):
    """Lines cite their order's parts by number, by id and by a number that there is not."""
    lines = t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_partkey").alias("id"))
    held = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("n", "id"))).alias("m"), F.max("id").alias("last"))
    cited = F.array(F.lit(2).cast("long"), F.lit(-7).cast("long"), F.col("last"), F.lit(1).cast("long"), F.lit(2).cast("long"))
    return held.select("l_orderkey", joined(kgraph.evidence(cited, F.col("m"))).alias("ids"))


# Runs over targets: suppliers are targets, parts compounds, the orders of a part its papers.

_RUN = """f AS (SELECT l_suppkey AS t, l_partkey AS c, min((l_orderkey, l_linenumber)) AS o FROM lineitem GROUP BY ALL), k AS (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY o, c) AS place FROM f),
x AS (SELECT DISTINCT t, l_orderkey AS p FROM k JOIN lineitem ON l_partkey = c WHERE place <= 5 AND l_returnflag = 'R')"""


def _run(t):
    literature = t("lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_orderkey")
    log = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return compounds.target_run(t("lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber")), literature, log, "l_suppkey", "l_partkey", ["at"], "l_orderkey")


@query(f"WITH {_RUN} SELECT t AS target, count(*) AS n_compounds, (SELECT count(*) FROM x WHERE x.t = k.t) AS n_ids FROM k GROUP BY t")
def target_counts(t):
    return _run(t)[1].select(F.col("l_suppkey").alias("target"), "n_compounds", "n_ids")


@query(f"WITH {_RUN} SELECT DISTINCT p AS id, 'queued' AS status FROM x WHERE p NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def target_queue(t):
    return _run(t)[2].select(F.col("l_orderkey").alias("id"), "status")


@query("SELECT p_partkey, 'mechanism' AS bucket, 'it works on ' || p_name || ' in ways' AS texts FROM part")
def page_sections_deep(t):
    """Pages whose only text lies one to twelve levels down."""
    inner = F.concat(F.lit('{"TOCHeading": "Mechanism of Action", "Information": [{"Value": {"StringWithMarkup": [{"String": "it works on '), "p_name", F.lit(' in ways"}]}}]}'))
    depth = F.col("p_partkey") % 12
    raw = F.concat(F.repeat(F.lit('{"TOCHeading": "Level", "Section": ['), depth.cast("int")), inner, F.repeat(F.lit("]}"), depth.cast("int")))
    return druglabels.page_sections(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw").select("p_partkey", "bucket", joined("texts", "|").alias("texts"))


# The work queue

@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'parse' WHEN 'purchase' THEN 'index' WHEN 'error' THEN 'fail' ELSE 'skip' END AS act, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 'queued' AS status, CAST(0 AS BIGINT) AS retries, CAST(0 AS DOUBLE) AS since, false AS moved FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, event_id, coalesce(nxt, cur), retries + CASE WHEN nxt = 'error' THEN 1 ELSE 0 END, CASE WHEN nxt IS NULL THEN since ELSE sec END, nxt IS NOT NULL FROM (
  SELECT *, CASE WHEN cur IN ('queued', 'error') AND act = 'claim' THEN 'fetching' WHEN cur = 'fetching' AND act = 'parse' THEN 'parsing' WHEN cur = 'fetching' AND act = 'skip' THEN 'skipped' WHEN cur IN ('fetching', 'parsing') AND act = 'fail' THEN 'error' WHEN cur = 'parsing' AND act = 'index' THEN 'indexed' END AS nxt
  FROM (SELECT s.user_id, e.k, e.event_id, e.sec, e.act, s.retries, s.since, CASE WHEN s.status IN ('fetching', 'parsing') AND e.sec - s.since > 86400 THEN 'queued' ELSE s.status END AS cur FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT user_id, event_id, status, retries, moved FROM s WHERE k > 0""")
def queue_stream(t):
    """Each user is a queued id: clicks claim, views parse, purchases index; a claim is stale after a day."""
    action = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "parse").when(F.col("event_type") == "purchase", "index").when(F.col("event_type") == "error", "fail").otherwise("skip")
    rows = t("events").select("user_id", "event_id", "ts", action.alias("action"))
    return arrived(t, rows, lambda s: processors.queue_stream(s, "user_id", "ts", "event_id", "action", 86400))
