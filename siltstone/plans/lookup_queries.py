"""Registered queries of look-ups and answers: drugs, intents, responses, models' graphs, ontology terms, lists of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, druglabels, fuzzy, graph, kgraph, lexical, upserts, vectors
from siltstone.plans.catalogue import _Q0, _answers, _nodes, _passages, _relations, ontology
from siltstone.plans.registry import joined, md5, query, r6

# Drugs: parts


@query("""SELECT p_partkey, md5('DRUG REFERENCE — ' || upper(p_name) || ' (FDA)' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Brand names: ' || p_brand || ', ' || p_type || chr(10) ELSE '' END || 'Indications: ' || p_type || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Warnings: ' || p_brand ELSE '' END) AS h FROM part""")
def drug_card(t):
    brands = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type"))
    fields = {"indications": F.col("p_type"), "mechanism": F.lit("  "), "warnings": F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))}
    return t("part").select("p_partkey", md5(druglabels.card_text(F.col("p_name"), F.lit("fda"), brands, fields)).alias("h"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]+')) AS w FROM documents WHERE lang = 'en')
SELECT doc_id, string_agg(DISTINCT w, ',' ORDER BY w) AS candidates FROM w WHERE w NOT IN ('worthless', 'disgusting') AND (regexp_matches(w, '(""" + "|".join(T.DRUG_ENDINGS) + """)$') OR length(w) >= 8 AND regexp_matches(w, '[xyz]') OR length(w) >= 10) GROUP BY doc_id""")
def drug_candidates(t):
    found = fuzzy.candidate_names(t("documents").where("lang = 'en'"), "text", ["worthless", "disgusting"])
    return found.where(F.size("candidates") > 0).select("doc_id", joined("candidates").alias("candidates"))


_ASK = [(1, "general", ["red plate", "blu plate"]), (2, "about_specific_drug", ["nosuch", "Brand#12"]), (3, "find_drugs_by_effect", ["red plate"]), (4, None, []), (5, "general", ["gren plaet"])]


def _questions(t):
    return t.spark.createDataFrame(_ASK, "q int, intent string, candidates array<string>")


def _drug_rows(t):
    return t("part").groupBy("p_name").agg(F.collect_set("p_brand").alias("brands"))


_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({c}), '[a-z0-9]+')]))"
_FOUND = f"""a AS (SELECT * FROM (VALUES (1, 'red plate'), (1, 'blu plate'), (2, 'nosuch'), (2, 'Brand#12'), (3, 'red plate'), (5, 'gren plaet')) x(q, c)), n AS (SELECT DISTINCT p_name FROM part),
ex AS (SELECT c, min(p_name) AS hit FROM a JOIN part ON lower(c) = lower(p_name) OR lower(c) = lower(p_brand) GROUP BY c),
sm AS (SELECT c, p_name, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS s FROM (SELECT DISTINCT c, {_GRAMS.format(c='c')} AS g FROM a WHERE c NOT IN (SELECT c FROM ex)), (SELECT p_name, {_GRAMS.format(c='p_name')} AS h FROM n)),
nr AS (SELECT c, arg_min(p_name, (-round(s, 9), p_name)) AS hit FROM sm WHERE s >= 0.5 GROUP BY c), hit AS (SELECT * FROM ex UNION ALL SELECT * FROM nr),
fw AS (SELECT a.q, a.c, hit AS p_name FROM a JOIN hit USING (c))"""


@query(f"WITH {_FOUND} SELECT q, c AS candidate, p_name FROM fw")
def forward_lookup(t):
    """The exact name or brand, else the most similar name of half the trigrams or more."""
    return druglabels.forward(_questions(t), _drug_rows(t), "q", "candidates", "p_name", "brands")


@query(f"""WITH {_FOUND}, nm AS (SELECT q, p_name, 'table' AS source, 0 AS o FROM fw WHERE q <> 3 UNION ALL SELECT 2, 'nosuch', 'external', 1),
rv AS (SELECT q, p_name, 'indication' AS source, o FROM (SELECT q FROM (SELECT unnest([3, 4, 5]) AS q) WHERE q NOT IN (SELECT q FROM nm)), (SELECT p_name, row_number() OVER (ORDER BY p_name) AS o FROM n ORDER BY p_name LIMIT 5)),
ev AS (SELECT q, p_name, arg_min(source, (o, source)) AS source, min(o) AS o FROM (SELECT * FROM nm UNION ALL SELECT * FROM rv) GROUP BY ALL)
SELECT q, p_name, source, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, p_name) AS place FROM ev) WHERE place <= 3""")
def drug_chain(t):
    """By name, then from outside, and by indication for questions without a card that are not about a certain drug."""
    q = _questions(t)
    found = druglabels.forward(q, _drug_rows(t), "q", "candidates", "p_name", "brands").withColumn("o", F.lit(0))
    outside = t.spark.createDataFrame([(2, "nosuch", 1), (3, "nosuch", 1)], "q int, p_name string, o int")
    by_effect = t("part").select("p_name").distinct().orderBy("p_name").limit(5).withColumn("o", F.row_number().over(Window.orderBy("p_name")))
    reverse = q.select("q").crossJoin(F.broadcast(by_effect))  # five rows for each of the few questions
    return druglabels.chain(q, "q", F.col("intent"), found, outside, reverse, "p_name", "o").select("q", "p_name", "source", F.col("place").cast("long"))


@query("SELECT DISTINCT p_name, CASE WHEN p_name LIKE 'red%' THEN 'fda' ELSE 'wikipedia' END AS source FROM part")
def external_cache(t):
    """Cards from outside are kept only for names that the table lacks."""
    names = t("part").select("p_name").distinct()
    return upserts.insert_ignore(names.where("p_name LIKE 'red%'").withColumn("source", F.lit("fda")), names.withColumn("source", F.lit("wikipedia")), ["p_name"], "source")


_PAGE = """SELECT doc_id, 'Intro line that says what this is about.' || chr(10) || '== Mechanism of action ==' || chr(10) || replace(lower(source), chr(10), ' ') || ' works.' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Early discovery of uses' || chr(10) || 'found by chance.' ELSE 'not a heading.' END AS page FROM documents"""


def _pages(t):
    page = F.concat(F.lit("Intro line that says what this is about.\n== Mechanism of action ==\n"), F.lower("source"), F.lit(" works.\n\n"), F.when(F.col("doc_id") % 2 == 0, "Early discovery of uses\nfound by chance.").otherwise("not a heading."))
    return t("documents").select("doc_id", page.alias("page"))


@query("""SELECT doc_id, 'summary' AS heading, 'Intro line that says what this is about.' AS content FROM documents
UNION ALL SELECT doc_id, 'mechanism of action', lower(source) || ' works.' || CASE WHEN doc_id % 2 = 1 THEN ' not a heading.' ELSE '' END FROM documents UNION ALL SELECT doc_id, 'early discovery of uses', 'found by chance.' FROM documents WHERE doc_id % 2 = 0""")
def article_sections(t):
    return druglabels.article_sections(_pages(t), "doc_id", "page")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'found by chance.' ELSE lower(source) || ' works.' || ' not a heading.' END AS content FROM documents")
def article_section_found(t):
    """The heading itself, or else all headings that contain a wanted part."""
    s = druglabels.article_sections(_pages(t), "doc_id", "page")
    even, odd = s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1")
    return druglabels.section_named(even, "doc_id", ["history", "discovery"]).unionByName(druglabels.section_named(odd, "doc_id", ["nothing", "mechanism of action"]))


@query("""SELECT p_partkey, 'mechanism' AS bucket, 'works on ' || p_name || ' in ways' AS texts FROM part UNION ALL SELECT p_partkey, 'warnings', p_brand || ' is a warning text|deeper ' || p_type || ' warning text' FROM part WHERE p_size % 2 = 0""")
def page_sections(t):
    info = lambda *texts: F.concat(F.lit('"Information": [{"Value": {"StringWithMarkup": ['), F.concat_ws(", ", *(F.concat(F.lit('{"String": "'), x, F.lit('"}')) for x in texts)), F.lit("]}}]"))
    deep = F.concat(F.lit('{"TOCHeading": "Boxed Warning now", '), info(F.concat(F.lit("deeper "), "p_type", F.lit(" warning text"))), F.lit("}"))
    warn = F.concat(F.lit('{"TOCHeading": "Drug Warning", '), info(F.concat("p_brand", F.lit(" is a warning text")), F.lit("short")), F.lit(', "Section": ['), deep, F.lit("]}"))
    mech = F.concat(F.lit('{"TOCHeading": "The MOA", '), info(F.concat(F.lit("works on "), "p_name", F.lit(" in ways"))), F.lit("}"))
    raw = F.concat(F.lit('{"TOCHeading": "Top", "Section": ['), F.when(F.col("p_size") % 2 == 0, F.concat(warn, F.lit(", "))).otherwise(""), F.lit('{"TOCHeading": "Other", "Section": ['), mech, F.lit("]}]}"))
    return druglabels.page_sections(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw").select("p_partkey", "bucket", joined("texts", "|").alias("texts"))


# Intents and responses

_KIND = "CASE p_size % 4 WHEN 0 THEN 'about_specific_drug' WHEN 1 THEN 'find_drugs_by_effect' WHEN 2 THEN 'dance' END"


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 4 > 1 THEN 'general' ELSE {_KIND} END AS intent, CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_name) END AS drug_names, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS terms FROM part")
def intent_parse(t):
    """Every fifth answer of the model is no JSON, and every fourth an unknown intent."""
    raw = F.concat(F.lit('Sure: {"intent": "'), F.coalesce(F.expr(_KIND), F.lit("?")), F.lit('", "drug_names": [" '), F.upper("p_name"), F.lit('"], "indication_terms": ["'), "p_type", F.lit(' "]} ok'))
    read = t("part").select("p_partkey", answer.intent(F.when(F.col("p_size") % 5 == 0, "no idea {").otherwise(raw)).alias("i"))
    return read.select("p_partkey", "i.intent", joined(F.col("i.drug_names")).alias("drug_names"), joined(F.col("i.indication_terms")).alias("terms"))


@query("SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'general' ELSE 'find_drugs_by_effect' END AS intent FROM conversations")
def intent_analysis(t):
    """An injected model that fails for every third text; then the intent is general."""

    def build():
        def model(text: str) -> str:
            if len(text) % 3 == 0:
                raise RuntimeError("no answer")
            return '{"intent": "find_drugs_by_effect"}'

        return model

    asked = answer.asked_model(t("conversations").select("conv_id", "turn", "text"), "text", build)
    return asked.select("conv_id", "turn", answer.intent(F.coalesce("raw", F.lit("")))["intent"].alias("intent"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'EXTRACTIVE:' || p_name WHEN 1 THEN 'm:' || length(p_name) END AS response FROM part")
def provider_dispatch(t):
    """Each row goes to the provider that its spec names; the last third names none."""
    spec = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "Model/x").otherwise("unknown")
    providers = {"extractive": lambda: lambda s: "EXTRACTIVE:" + s, "model": lambda: lambda s: f"m:{len(s)}"}
    return answer.synthesised(t("part").select("p_partkey", "p_name", "p_size"), spec, "p_name", providers).select("p_partkey", "response")


@query("""WITH a AS (SELECT conv_id * 100 + turn AS answer, text, turn FROM conversations WHERE role = 'assistant'), p AS (SELECT answer, (turn // 2) % 2 = 0 AS cites FROM a), i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark),
c AS (SELECT answer, x AS old, item_id FROM a, (SELECT unnest([1, 2, 3]) AS x), i WHERE (answer * 3 + x) % n = k)
SELECT a.answer, md5(text || CASE WHEN cites THEN ' [2][1]. Then [9].' ELSE ' [1][2]. Then [9].' END) AS h, CASE WHEN cites THEN (SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY 3 - old) FROM c WHERE c.answer = a.answer AND old < 3) ELSE (SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY old) FROM c WHERE c.answer = a.answer) END AS cited
FROM a JOIN p USING (answer)""")
def response_assembly(t):
    """Half of the answers cite their second passage, then the first, the second again and a foreign one; the others cite none."""
    rows = _answers(t)
    chunks = _passages(t, rows).select("answer", "number", F.col("item_id").alias("chunk"))
    by = chunks.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("number", "chunk"))).alias("m"))
    cites = F.floor(F.pmod("answer", F.lit(100)) / 2) % 2 == 0
    named = F.when(cites, F.array(F.col("m")[2], F.col("m")[1], F.col("m")[2], F.lit(-5).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = answer.assembled(rows.join(by, "answer").withColumn("cited", named), chunks, "answer", "response", "cited", "number", "chunk")
    return out.select("answer", md5("response").alias("h"), joined(F.col("citations.chunk_id")).alias("cited"))


@query("SELECT doc_id, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS pubmed_url, CASE WHEN doc_id % 2 = 0 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || doc_id || '/' END AS pmc_url FROM documents")
def record_links(t):
    k = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", answer.links(k, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("PMC"), k))).alias("l")).select("doc_id", "l.*")


@query("SELECT conv_id, md5(string_agg('[' || n || '] Source: ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS h FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id")
def context_blocks(t):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return answer.context_block(t("conversations").withColumn("n", place), "conv_id", "n", F.col("role"), "text").select("conv_id", md5("context").alias("h"))


@query("SELECT o_orderkey, l_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos, l_suppkey) AS number FROM (SELECT l_orderkey AS o_orderkey, l_suppkey, min(l_linenumber * 100000 + l_partkey) AS pos FROM lineitem GROUP BY ALL)")
def citation_numbers(t):
    rows = t("lineitem").withColumn("at", F.col("l_linenumber") * 100000 + F.col("l_partkey"))
    return answer.citation_order(rows, "l_orderkey", "l_suppkey", "at").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("number").cast("long"))


@query("SELECT conv_id, turn, md5(coalesce((SELECT string_agg(text, chr(10) ORDER BY turn) FROM (SELECT text, turn, role FROM conversations h WHERE h.conv_id = c.conv_id AND h.turn < c.turn ORDER BY turn DESC LIMIT 6) WHERE role = 'user'), '')) AS h FROM conversations c")
def history_user(t):
    """The user's turns among the last six before each."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    listed = F.filter(F.collect_list(F.struct("role", "text")).over(before), lambda m: m["role"] == "user")
    return t("conversations").withColumn("h", listed).select("conv_id", "turn", md5(F.array_join(F.col("h.text"), "\n")).alias("h"))


# Graphs of models


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN '' ELSE lower(p_name) || '=' || CASE p_size % 4 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'OTHER' ELSE 'GENE' END END AS types FROM part")
def kg_types(t):
    kind = F.element_at(F.array(F.lit(" drug"), F.lit("planet"), F.lit("Gene "), F.lit("x")), (F.col("p_size") % 4 + 1).cast("int"))
    whole = F.concat(F.lit('{"relations": [], "types": {" '), F.upper("p_name"), F.lit('": "'), kind, F.lit('"}} trailing'))
    raw = F.when(F.col("p_size") % 4 == 3, '{"relations": [], "types": ["no"]}').otherwise(whole)
    return t("part").select("p_partkey", F.array_join(F.transform(F.map_entries(kgraph.node_types(raw)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("types"))


@query("SELECT doc_id, length(text) > 5000 AS truncated, md5(left(text, 5000)) AS h FROM documents")
def extraction_prompt(t):
    return t("documents").select("doc_id", kgraph.prompt(F.col("text")).alias("p")).select("doc_id", "p.truncated", md5("p.text").alias("h"))


@query("""WITH n AS (SELECT DISTINCT p_size AS g, p_name || ' ' || p_type AS label FROM part), w AS (SELECT g, label, list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+')) AS w FROM n)
SELECT g, coalesce(bool_or(b.label IS NOT NULL), false) AS hint FROM w a LEFT JOIN w b USING (g) WHERE b.label IS NULL OR true GROUP BY g HAVING false
UNION ALL SELECT g, bool_or(EXISTS (SELECT 1 FROM w b WHERE b.g = a.g AND b.label <> a.label AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.7)) FROM w a GROUP BY g""")
def duplicate_hint(t):
    labels = t("part").select(F.col("p_size").alias("g"), F.concat_ws(" ", "p_name", "p_type").alias("label")).distinct()
    return kgraph.has_duplicates(labels, "g", "label", lexical.tokens(F.col("label")))


@query("SELECT p_brand, CAST(count(DISTINCT p_name) AS BIGINT) AS groups FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1 HAVING count(DISTINCT p_name) >= 2 UNION ALL SELECT 'Brand#11', NULL FROM part WHERE p_brand = 'Brand#11' HAVING count(DISTINCT p_name) >= 2")
def dedup_groups(t):
    """The provider counts its labels; one brand names a provider that there is not."""
    rows = t("part").withColumn("spec", F.when(F.col("p_brand") == "Brand#11", "none").otherwise("counter/v1"))
    found = kgraph.grouped(rows, "p_brand", "p_name", "spec", {"counter": lambda: lambda s: str(len(s.split("\n")))})
    return found.select("p_brand", F.col("groups").cast("long").alias("groups"))


@query("WITH r AS (SELECT l_orderkey AS graph, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 5 AND l_returnflag <> 'A' AND p_brand NOT LIKE '%4' GROUP BY ALL) SELECT graph FROM r")
def session_round_trip(t):
    """Graphs are exported as JSON and read back; those whose edges are all there again are listed."""
    nodes = _nodes(t)
    found = kgraph.edges(_relations(t), nodes, "graph", "at")
    return kgraph.whole(kgraph.exported(found, nodes, "graph"), "graph")


# Ontology and vectors

_TREE = """n AS (SELECT r_name AS name, 'R' || r_regionkey AS path FROM region UNION ALL SELECT n_name, 'R' || n_regionkey || '.N' || n_nationkey FROM nation
UNION ALL SELECT c_name, 'R' || n_regionkey || '.N' || n_nationkey || '.C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {_TREE}, r AS (SELECT name, path FROM n WHERE name IN ('ASIA', 'FRANCE')) SELECT lower(r.name) AS query_term, md5(string_agg(DISTINCT n.name, ',' ORDER BY n.name)) AS names FROM r JOIN n ON n.path = r.path OR starts_with(n.path, r.path || '.') GROUP BY 1")
def term_expansion(t):
    asked = t.spark.createDataFrame([("asia",), ("france",), ("nowhere",)], "query_term string")
    found = graph.expand_terms(asked, ontology(t).withColumn("name", F.col("ui")), "ui", "name", "paths")
    return found.select("query_term", md5(joined("names")).alias("names"))


@query()
def dense_lists(t):
    """The twenty nearest from inverted lists kept by list; recall is tested against the exact scan."""
    listed, centres = vectors.inverted_lists(t("embeddings"), "vec_id", "embedding")
    kept = t.kept("vector-lists", lambda: listed, "list")
    return vectors.listed_topk(kept, centres, _Q0, 20, "vec_id", "embedding", probes=48).withColumn("similarity", r6("similarity"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k = 1 GROUP BY 1")
def distinct_facets(t):
    """Of the results of a search the first of each language and source: duplicates of a key go, the first place stays."""
    first = upserts.latest(t("documents").withColumn("neg", -F.col("doc_id")).withColumn("k", F.concat_ws("|", "source", "lang")), "k", ["neg"])
    return first.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name || ' (' || p_brand || ')' END AS kept FROM part WHERE p_name <> 'red plate'")
def node_removal(t):
    """Edges of a removed node go with it; a node's own data is what is left of them."""
    edges = t("part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_brand").alias("target"), "p_size")
    return kgraph.without_node(edges, "red plate").select("p_partkey", F.when(F.col("p_size") < 10, F.concat("source", F.lit(" ("), "target", F.lit(")"))).alias("kept"))


