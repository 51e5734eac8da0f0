"""Registered queries over the engine's own operators, with DuckDB oracles.

Roles of the tables: documents are papers, orders with their lines are papers with headings or chunks with entities, lines
are also citations, customers sit in a region-nation-customer ontology, parts are drugs, events are queue and cache events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.stemmer import stem_all
from siltstone.operators import answer, chunking, fusion, fuzzy, graph, kgraph, lexical, upserts, vectors
from siltstone.plans.registry import ORACLES, QUERIES, joined, longs, md5, query, r6
from siltstone.sources import records, tables
from siltstone.streaming import state

__all__ = ["ORACLES", "QUERIES"]
TERMS = ["that", "onesen", "erblest", "thou"]
IN_TERMS = ", ".join(f"'{t}'" for t in TERMS)
TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


# Lexical retrieval


def kept_index(t, name: str, table: str, id_col: str, columns: list[str]) -> lexical.Index:
    """Postings and statistics of a table, written by the first query that needs them."""
    fields = {c: lexical.tokens(F.col(c)) for c in columns}
    post = t.kept(f"{name}-postings", lambda: lexical.postings(t(table), id_col, fields), "bucket")
    return lexical.Index(post, t.kept(f"{name}-stats", lambda: lexical.statistics(t(table), id_col, fields)))


def corpus(t) -> lexical.Index:
    return kept_index(t, "documents", "documents", "doc_id", ["text"])


BM25 = f"""d AS (SELECT doc_id AS doc, {TOK.format(c="text")} AS t FROM documents), l AS (SELECT doc, len(t) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM d) WHERE term IN ({IN_TERMS}) GROUP BY doc, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT p.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS matched
  FROM p JOIN f USING (term) JOIN l USING (doc) CROSS JOIN s GROUP BY p.doc)"""


@query(f"WITH {BM25} SELECT doc, round(score, 6) AS score, matched FROM sc ORDER BY round(score, 9) DESC, doc LIMIT 100")
def bm25_topk(t):
    return lexical.search(corpus(t), TERMS, 100).withColumn("score", r6("score"))


@query(f"WITH {BM25} SELECT doc, round(score, 6) AS score FROM sc JOIN documents ON doc_id = doc WHERE lang IN ('en', 'fr') AND source <> 'src3' AND n_chars BETWEEN 500 AND 5000")
def bm25_filtered(t):
    allowed = t("documents").where(F.col("lang").isin("en", "fr") & (F.col("source") != "src3") & F.col("n_chars").between(500, 5000)).select(F.col("doc_id").alias("doc"))
    return lexical.search(corpus(t), TERMS, allowed=allowed).select("doc", r6("score").alias("score"))


@query(f"WITH {BM25} SELECT doc, matched FROM sc WHERE matched >= 2")
def msm_half(t):
    return lexical.search(corpus(t), TERMS, least_share=0.5).select("doc", "matched")


_MULTI = ["red", "plate", "brass", "brand"]
_BOOSTS = {"p_name": 0.5, "p_type": 2.0, "p_brand": 1.5}
_FIELD = " UNION ALL ".join(f"SELECT p_partkey AS doc, '{f}' AS field, {b} AS boost, {TOK.format(c=f)} AS t FROM part" for f, b in _BOOSTS.items())


@query(f"""WITH x AS ({_FIELD}), s AS (SELECT field, count(*) AS n, avg(len(t)) AS mean FROM x GROUP BY field),
p AS (SELECT doc, field, boost, len, term, count(*) AS tf FROM (SELECT doc, field, boost, len(t) AS len, unnest(t) AS term FROM x) WHERE term IN ('red', 'plate', 'brass', 'brand') GROUP BY ALL),
f AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
b AS (SELECT doc, term, max(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS v FROM p JOIN f USING (field, term) JOIN s USING (field) GROUP BY doc, term)
SELECT doc, round(sum(v), 6) AS score FROM b GROUP BY doc""")
def bm25_multifield(t):
    return lexical.search(kept_index(t, "part", "part", "p_partkey", list(_BOOSTS)), _MULTI, boosts=_BOOSTS).select("doc", r6("score").alias("score"))


@query(f"""WITH x AS ({_FIELD}), s AS (SELECT field, count(*) AS n, avg(len(t)) AS mean FROM x GROUP BY field),
p AS (SELECT doc, field, boost, len, term, count(*) AS tf FROM (SELECT doc, field, boost, len(t) AS len, unnest(t) AS term FROM x) WHERE term IN ('red', 'plate', 'brass', 'brand') GROUP BY ALL),
f AS (SELECT term, max(df) AS df FROM (SELECT field, term, count(*) AS df FROM p GROUP BY ALL) GROUP BY term),
b AS (SELECT doc, term, max(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS v FROM p JOIN f USING (term) JOIN s USING (field) GROUP BY doc, term)
SELECT doc, round(sum(v), 6) AS score FROM b GROUP BY doc""")
def bm25_blended(t):
    return lexical.search(kept_index(t, "part", "part", "p_partkey", list(_BOOSTS)), _MULTI, boosts=_BOOSTS, blend=True).select("doc", r6("score").alias("score"))


@query()
def english_analyzer(t):
    return t("documents").select("doc_id", joined(stem_all(lexical.analysed(F.col("text"))), " ").alias("stems"))


# Neighbouring hits share the character between them, so the rule is applied twice.
_MARKED = r"""replace(replace(regexp_replace(regexp_replace({c}, '(?i)(^|[^a-z0-9])(that|thou)($|[^a-z0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '(?i)(^|[^a-z0-9\x01])(that|thou)($|[^a-z0-9\x02])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1), '<em>'), chr(2), '</em>')"""


@query(rf"SELECT doc_id, md5({_MARKED.format(c='text')}) AS h, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(that|thou)($|[^a-z0-9])')")
def highlights(t):
    marked = lexical.highlight(F.col("text"), ["that", "thou"])
    return t("documents").where(F.col("text") != marked).select("doc_id", md5(marked).alias("h"), F.size(lexical.tokens(F.col("text"))).cast("long").alias("n"))


_WINDOW_HITS = "len([x for x in regexp_extract_all(lower(w), '[a-z0-9]+') if x IN ('that', 'thou')])"


@query(rf"""WITH w AS (SELECT doc_id, i, substr(text, i * 200 + 1, 200) AS w FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS i FROM documents)),
r AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id ORDER BY {_WINDOW_HITS} DESC, i) AS place FROM w WHERE {_WINDOW_HITS} > 0)
SELECT doc_id, CAST(place AS BIGINT) AS place, md5({_MARKED.format(c='w')}) AS h FROM r WHERE place <= 2""")
def highlight_fragments(t):
    found = t("documents").select("doc_id", F.posexplode(lexical.fragments(F.col("text"), ["that", "thou"])).alias("at", "f"))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("place"), md5("f").alias("h"))


# Dense, sparse, fused

_Q0 = [round(((k * 37) % 19 - 9) / 9, 6) for k in range(64)]
_QSQL = "[" + ", ".join(str(x) for x in _Q0) + "]::DOUBLE[]"
_DENSE = f"v AS (SELECT vec_id AS doc, list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) AS sim FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"WITH {_DENSE} SELECT doc AS vec_id, round(sim, 6) AS similarity FROM v ORDER BY round(sim, 9) DESC, doc LIMIT 20")
def dense_topk(t):
    return vectors.dense_topk(t("embeddings"), _Q0, 20, "vec_id", "embedding").withColumn("similarity", r6("similarity"))


@query(f"""WITH {_DENSE}, r AS (SELECT doc, row_number() OVER (ORDER BY round(sim, 9) DESC, doc) AS rank FROM v ORDER BY rank LIMIT 200)
SELECT label, min(rank) AS best, max(rank) AS worst FROM r JOIN embeddings ON vec_id = doc GROUP BY label""")
def dense_rank_worst_best(t):
    top = fusion.ranked(vectors.dense_topk(t("embeddings"), _Q0, 200, "vec_id", "embedding"), "vec_id", "similarity", "rank")
    of = top.join(t("embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc")
    best, worst = fusion.last_rank(of, "label", "rank"), fusion.last_rank(of, "label", "rank", compat=True)
    return best.withColumnRenamed("rank", "best").join(worst.withColumnRenamed("rank", "worst"), "label").select("label", F.col("best").cast("long"), F.col("worst").cast("long"))


_LINES = f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, line, term, ln(1 + count(*)) AS w FROM (SELECT doc_id, line, unnest({TOK.format(c="s")}) AS term FROM l) GROUP BY ALL), p AS (SELECT doc_id, term, max(w) AS w FROM w GROUP BY ALL)"""


def line_weights(t) -> DataFrame:
    # Texts are dealt by document, so that their words need no shuffle until terms are counted over documents.
    docs = t("documents").select("doc_id", "text")
    lines = docs.repartition(tables.text_tasks(docs, 8 << 20), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    counted = lines.select("doc_id", "line", F.explode(lexical.tokens(F.col("s"))).alias("term")).groupBy("doc_id", "line", "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("w", vectors.saturate(F.col("tf")))


@query(_LINES + " SELECT term, count(*) AS docs, round(sum(w), 5) AS total FROM p GROUP BY term HAVING count(*) >= 5")
def sparse_maxpool(t):
    pooled = vectors.max_pool(line_weights(t), "doc_id", "term", "w")
    return pooled.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("w"), 5).alias("total")).where("docs >= 5")


@query(_LINES + " SELECT doc_id, round(sum(w * CASE term WHEN 'that' THEN 0.4 WHEN 'thou' THEN 1.3 ELSE 2.1 END), 6) AS score FROM p WHERE term IN ('that', 'thou', 'onesen') GROUP BY doc_id ORDER BY round(sum(w * CASE term WHEN 'that' THEN 0.4 WHEN 'thou' THEN 1.3 ELSE 2.1 END), 9) DESC, doc_id LIMIT 50")
def sparse_search(t):
    pooled = vectors.max_pool(line_weights(t), "doc_id", "term", "w")
    return vectors.sparse_search(pooled, {"that": 0.4, "thou": 1.3, "onesen": 2.1}, "doc_id", "term", 50).withColumn("score", r6("score"))


def fused(t, top_k: int = 20) -> DataFrame:
    pool = fusion.pool_size(top_k)
    bm25 = fusion.ranked(lexical.search(corpus(t), TERMS, pool), "doc", "score", "bm25_rank")
    dense = fusion.ranked(vectors.dense_topk(t("embeddings"), _Q0, pool, "vec_id", "embedding"), "vec_id", "similarity", "dense_rank")
    return fusion.fuse(bm25, dense, "bm25_rank", "dense_rank")


_FUSED = f"""{BM25}, {_DENSE},
b AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS bm25_rank FROM sc ORDER BY 2 LIMIT 100),
e AS (SELECT doc, row_number() OVER (ORDER BY round(sim, 9) DESC, doc) AS dense_rank FROM v ORDER BY 2 LIMIT 100),
u AS (SELECT coalesce(b.doc, e.doc) AS doc, bm25_rank, dense_rank, coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0) AS rrf FROM b FULL JOIN e ON b.doc = e.doc)"""


@query(f"WITH {_FUSED} SELECT doc, bm25_rank, dense_rank, round(rrf, 9) AS rrf FROM u")
def rrf_fusion(t):
    return fused(t).select("doc", F.col("bm25_rank").cast("long"), F.col("dense_rank").cast("long"), F.round("rrf", 9).alias("rrf"))


_PLACED = f"""{_FUSED}, pl AS (SELECT *, count(*) OVER () AS pool, row_number() OVER (ORDER BY round(rrf, 9) DESC, doc) AS place FROM u),
tg AS (SELECT *, least(greatest(5, least(20, CAST(floor(pool * 0.10) AS BIGINT))), 20) AS target FROM pl)"""


@query(f"WITH {_PLACED} SELECT doc, place, target, pool FROM tg WHERE place <= target")
def adaptive_target(t):
    return fusion.adaptive(fused(t), 20).select("doc", F.col("place").cast("long"), F.col("target").cast("long"), "pool")


_PARA = """c AS (SELECT doc_id AS doc, i - 1 AS idx, s FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, trim(unnest(x)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE length(s) >= 30)"""


def para_rows(t) -> DataFrame:
    rows = t("documents").select(F.col("doc_id").alias("doc"), F.explode(chunking.paragraphs(F.col("text"), "\n")).alias("p"))
    return rows.select("doc", F.col("p.paragraph_index").alias("idx"), F.col("p.text").alias("s"))


@query(f"WITH {_PARA} SELECT doc, CAST(idx AS BIGINT) AS idx, length(s) AS n, greatest(1, length(s) // 4) AS token_count FROM c")
def paragraph_chunks(t):
    return para_rows(t).select("doc", F.col("idx").cast("long"), F.length("s").cast("long").alias("n"), T.approx_tokens(F.col("s")).cast("long").alias("token_count"))


@query(f"WITH {_PARA}, k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS rn FROM c) SELECT doc, CAST(idx AS BIGINT) AS idx, rn, md5(s) AS h, lang, source FROM k JOIN documents ON doc_id = doc WHERE rn <= 3")
def hydrate_chunks(t):
    first = fusion.first_chunks(para_rows(t), "doc", "idx")
    return first.join(t("documents").select(F.col("doc_id").alias("doc"), "lang", "source"), "doc").select("doc", F.col("idx").cast("long"), F.col("chunk_place").cast("long").alias("rn"), F.md5(F.col("s").cast("binary")).alias("h"), "lang", "source")


_ALLOWED = "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 20000"


def allowed(t) -> DataFrame:
    """Filters of a search: any of the languages, and a range; they do not score."""
    return t("documents").where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(200, 20000)).select(F.col("doc_id").alias("doc"))


# The lexical side obeys the filters, the dense side does not.
_RANKED = f"""{BM25}, {_DENSE},
b AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS bm25_rank FROM sc WHERE matched >= 2 AND doc IN ({_ALLOWED}) ORDER BY 2 LIMIT 100),
dn AS (SELECT doc, row_number() OVER (ORDER BY round(sim, 9) DESC, doc) AS dense_rank FROM v ORDER BY 2 LIMIT 100),
u AS (SELECT coalesce(b.doc, dn.doc) AS doc, bm25_rank, dense_rank, coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0) AS rrf FROM b FULL JOIN dn ON b.doc = dn.doc),
pl AS (SELECT *, count(*) OVER () AS pool, row_number() OVER (ORDER BY round(rrf, 9) DESC, doc) AS place FROM u),
tg AS (SELECT *, least(greatest(5, least(20, CAST(floor(pool * 0.10) AS BIGINT))), 20) AS target FROM pl)"""


def _pool(t, widen: int) -> DataFrame:
    return fusion.retrieved(corpus(t), TERMS, t("embeddings"), _Q0, "vec_id", "embedding", 20, allowed(t), widen)


@query(f"""WITH {_RANKED}, {_PARA}, k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS rn FROM c)
SELECT tg.doc, place, rn AS chunk_place, CAST(idx AS BIGINT) AS idx, round(least(rrf / (2.0 / 61), 1.0), 4) AS relevance, bm25_rank, dense_rank, lang, source
FROM tg JOIN k ON k.doc = tg.doc AND rn <= 3 JOIN documents ON doc_id = tg.doc WHERE place <= target""")
def retrieve_full(t):
    kept = _pool(t, 1)
    # The kept documents are at most top_k.
    chunks = fusion.first_chunks(para_rows(t).join(F.broadcast(kept.select("doc")), "doc"), "doc", "idx")
    found = kept.join(chunks, "doc").join(t("documents").select(F.col("doc_id").alias("doc"), "lang", "source"), "doc")
    return found.select("doc", *longs("place", "chunk_place", "idx", "bm25_rank", "dense_rank"), fusion.normalised(F.col("rrf")).alias("relevance"), "lang", "source")


# Words of nine letters or more stand in for the tagged entities of a paragraph; the question's are those of its terms' best document.
_DOC_GRAPH = """m AS (SELECT DISTINCT doc * 100000 + idx AS g, doc, e FROM (SELECT doc, idx, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS e FROM c) WHERE length(e) >= 9),
ner AS (SELECT x.e AS a, y.e AS b, count(*) AS weight FROM m x JOIN m y ON x.g = y.g AND x.e < y.e GROUP BY ALL)"""
_ASKED_FOR = ["thanedble", "worthless", "disgusting", "ofonrereer", "forrendsten"]


def doc_members(t) -> DataFrame:
    """(chunk, doc, entity) of all paragraphs."""
    # Distinct in each paragraph's row: nothing is exchanged for it.
    words = F.array_distinct(F.filter(lexical.tokens(F.col("s")), lambda w: F.length(w) >= 9))
    return para_rows(t).select((F.col("doc") * 100000 + F.col("idx")).alias("chunk"), "doc", F.explode(words).alias("entity"))


def doc_edges(t) -> DataFrame:
    return t.kept("document-edges", lambda: graph.symmetric(graph.weighted(graph.entity_rows(doc_members(t), "chunk", "entity")), 1))


@query(f"""SELECT doc_id, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS e FROM documents)
WHERE e IN ({", ".join(repr(x) for x in _ASKED_FOR)}) GROUP BY doc_id""")
def query_entities(t):
    names = t.spark.createDataFrame([(e.upper(),) for e in _ASKED_FOR], "name string")
    found = graph.dictionary_entities(t("documents"), "doc_id", "text", names, "name")
    return found.groupBy("doc_id").agg(joined(F.sort_array(F.collect_set("entity"))).alias("entities"))


@query(f"""WITH d AS (SELECT doc_id AS doc, {TOK.format(c="text")} AS t FROM documents), l AS (SELECT doc, len(t) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(t) AS term FROM d WHERE doc = 1) GROUP BY term),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM d) JOIN q USING (term) GROUP BY doc, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT doc, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc) CROSS JOIN s GROUP BY doc)
SELECT doc, round(score, 5) AS score FROM sc WHERE doc <> 1 ORDER BY round(score, 9) DESC, doc LIMIT 20""")
def similar_docs(t):
    """The document's whole text is the query; the document itself is left out."""
    terms = lexical.terms_of(t("documents").where("doc_id = 1"), F.col("text"))
    found = lexical.search(corpus(t), terms).where("doc <> 1")
    return found.orderBy(F.desc(F.round("score", 9)), "doc").limit(20).select("doc", F.round("score", 5).alias("score"))


@query(f"WITH {BM25}, o AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS position, count(*) OVER () AS total FROM sc) SELECT doc, position, total FROM o WHERE position BETWEEN 11 AND 30")
def search_page(t):
    return fusion.page(lexical.search(corpus(t), TERMS), [F.desc(F.round("score", 9)), F.col("doc")], 10, 20).select("doc", F.col("position").cast("long"), "total")


# Chunking


@query("""WITH n AS (SELECT doc_id, text, CAST(greatest(0, ceil((length(text) - 2048) / 1536)) AS BIGINT) AS last FROM documents)
SELECT doc_id, i AS chunk_index, i * 1536 AS start_char, length(substr(text, i * 1536 + 1, 2048)) AS n FROM (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM n)""")
def window_chunks_fixed(t):
    rows = chunking.chunk_rows(t("documents"), "doc_id", "text", chunking.fixed_windows(F.col("text")))
    return rows.select("doc_id", F.col("chunk_index").cast("long"), F.col("start_char").cast("long"), F.length("chunk_text").cast("long").alias("n"))


_LAST = "CASE WHEN instr(reverse(seg), {r}) > 0 THEN low + length(seg) - instr(reverse(seg), {r}) + 1 END"
_SNAP = "coalesce(" + ", ".join(_LAST.format(r=r) for r in ("' .'", "' ?'", "' !'", "chr(10)")) + ", e)"


@query(f"""WITH RECURSIVE w(doc_id, text, n, start, stop) AS (
  SELECT doc_id, text, length(text), 0, CASE WHEN e < length(text) THEN {_SNAP} ELSE e END FROM (SELECT doc_id, text, least(2048, length(text)) AS e, 768 AS low, substr(text, 769, least(2048, length(text)) - 768) AS seg FROM documents WHERE length(text) > 0)
  UNION ALL SELECT doc_id, text, n, s, CASE WHEN e < n THEN {_SNAP} ELSE e END FROM (SELECT doc_id, text, n, s, least(s + 2048, n) AS e, s + 768 AS low, substr(text, s + 769, least(s + 2048, n) - s - 768) AS seg
    FROM (SELECT doc_id, text, n, greatest(stop - 512, start + 1) AS s FROM w WHERE stop < n)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, CAST(start AS BIGINT) AS start_char, CAST(stop AS BIGINT) AS end_char, md5(trim(substr(text, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(13))) AS h
FROM w WHERE trim(substr(text, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def window_chunks_snap(t):
    cut = t("documents").select("doc_id", F.posexplode(chunking.snapped_windows(F.col("text"))).alias("chunk_index", "w"))
    return cut.select("doc_id", F.col("chunk_index").cast("long"), F.col("w.start").cast("long").alias("start_char"), F.col("w.end").cast("long").alias("end_char"), md5("w.text").alias("h"))


@query(f"WITH {_PARA}, f AS (SELECT doc, s, min(idx) AS idx FROM c GROUP BY doc, s) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS chunk_index, md5(s) AS h FROM f")
def append_chunks(t):
    # Texts are dealt by document once: a paragraph's first place and its number are found where it lies.
    docs = t("documents").select("doc_id", "text")
    rows = docs.repartition(tables.text_tasks(docs), "doc_id").select(F.col("doc_id").alias("doc"), F.explode(chunking.paragraphs(F.col("text"), "\n")).alias("p"))
    first = rows.select("doc", F.col("p.paragraph_index").alias("idx"), F.col("p.text").alias("s")).groupBy("doc", "s").agg(F.min("idx").alias("idx"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("idx")) - 1
    every = first.withColumn("chunk_index", place).select("doc", "chunk_index", F.col("s").alias("chunk_text"))
    both = chunking.append_chunks(every.where("chunk_index < 2"), every, "doc")
    both = chunking.append_chunks(both, every, "doc")  # the second run adds nothing
    return both.select("doc", F.col("chunk_index").cast("long"), md5("chunk_text").alias("h"))


# Graphs


def brand_members(t) -> DataFrame:
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk"), F.col("p_brand").alias("entity"))


_BRANDS = "m AS (SELECT DISTINCT l_orderkey AS g, lower(p_brand) AS e FROM lineitem JOIN part ON l_partkey = p_partkey), ner AS (SELECT x.e AS a, y.e AS b, count(*) AS weight, list(x.g) AS sources FROM m x JOIN m y ON x.g = y.g AND x.e < y.e GROUP BY ALL)"
_MESH = """h AS (SELECT DISTINCT l_orderkey AS p, l_partkey AS k, lower(p_name) AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
mesh AS (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, count(DISTINCT x.p) AS weight, list(DISTINCT x.p) AS sources FROM h x JOIN h y ON x.p = y.p AND x.k < y.k GROUP BY 1, 2 HAVING count(DISTINCT x.p) >= 2)"""


def part_rows(t) -> DataFrame:
    return graph.heading_rows(t("lineitem"), t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_orderkey", "l_partkey", "p_name")


def brand_rows(t) -> DataFrame:
    return graph.entity_rows(brand_members(t), "chunk", "entity")


@query(f"WITH {_MESH} SELECT a, b, weight, CAST(list_sum(sources) AS BIGINT) AS source_sum FROM mesh")
def mesh_cooccurrence(t):
    return part_rows(t).distinct().groupBy("a", "b").agg(F.count("*").alias("weight"), F.sum("source").alias("source_sum")).where("weight >= 2")


@query(f"WITH {_BRANDS} SELECT a, b, weight FROM ner")
def ner_cooccurrence(t):
    return graph.weighted(brand_rows(t))


@query(f"WITH {_BRANDS}, {_MESH}, u AS (SELECT a, b, weight, sources FROM ner UNION ALL SELECT a, b, weight, sources FROM mesh) SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight, CAST(len(list_distinct(flatten(list(sources)))) AS BIGINT) AS n_sources FROM u GROUP BY a, b")
def graph_merge(t):
    return graph.merged(brand_rows(t), part_rows(t), least=[1, 2])


@query(f"WITH {_BRANDS} SELECT a, b, weight FROM ner")
def graph_incremental(t):
    members = brand_members(t)
    base = graph.entity_rows(members.where("chunk % 3 <> 0"), "chunk", "entity")
    # The whole table arrives: chunks that edges already cite are skipped.
    return graph.weighted(graph.increment(base, members, "chunk", "entity"))


@query("SELECT p_brand, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS orders FROM (SELECT DISTINCT p_brand, l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand")
def provenance_lists(t):
    return brand_members(t).groupBy(F.col("entity").alias("p_brand")).agg(joined(F.sort_array(F.collect_set("chunk"))).alias("orders"))


_SEEDS = ["brand#11", "brand#23", "nothing"]


def _ppr_sql(rounds: int, members: str = _BRANDS, seeds: list[str] = _SEEDS, least: int = 2) -> str:
    some = ", ".join(f"'{x}'" for x in seeds)
    steps = [f"WITH {members}, e AS (SELECT a AS src, b AS dst, weight FROM ner WHERE weight >= {least} UNION ALL SELECT b, a, weight FROM ner WHERE weight >= {least}), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY src), mv AS MATERIALIZED (SELECT e.src, dst, weight / total AS share FROM e JOIN o USING (src))"]
    steps.append(f"nd AS (SELECT DISTINCT src AS node FROM e), sd AS (SELECT node, CASE WHEN node IN ({some}) THEN 1.0 ELSE 0.0 END / (SELECT count(*) FROM nd WHERE node IN ({some})) AS seed FROM nd)")
    steps.append("r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM nd) AS rank FROM nd)")
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT sd.node, 0.9 * coalesce(sum(share * rank), 0) + 0.1 * any_value(seed) AS rank FROM sd LEFT JOIN mv ON mv.dst = sd.node LEFT JOIN r{k} ON r{k}.node = mv.src GROUP BY sd.node)")
    return ", ".join(steps)


def brand_edges(t) -> DataFrame:
    return t.kept("brand-edges", lambda: graph.symmetric(graph.weighted(brand_rows(t)), 2))


def _ppr(t) -> DataFrame:
    return graph.personalised_pagerank(brand_edges(t), _SEEDS, 10, tolerance=0)


@query(_ppr_sql(10) + " SELECT node, round(rank, 6) AS rank FROM r10")
def ppr(t):
    return _ppr(t).select("node", r6("rank").alias("rank"))


@query(_ppr_sql(10) + " SELECT node, round(rank, 6) AS rank FROM r10")
def ppr_joins(t):
    """The same ranks by the way that large graphs take: here a few blocks of ranks, and units of their edges."""
    return graph.personalised_pagerank(brand_edges(t), _SEEDS, 10, tolerance=0, one_task_edges=0, block_nodes=8, unit_edges=64).select("node", r6("rank").alias("rank"))


@query(_ppr_sql(10) + ", tp AS (SELECT * FROM r10 ORDER BY round(rank, 12) DESC, node LIMIT 10) SELECT g AS chunk, round(sum(rank), 6) AS boost FROM m JOIN tp ON node = e GROUP BY g")
def ppr_rerank(t):
    return graph.chunk_boosts(brand_members(t), graph.top_entities(_ppr(t), 10), "chunk", "entity").withColumn("boost", r6("boost"))


@query(f"""{_ppr_sql(10, f"{_PARA}, {_DOC_GRAPH}", _ASKED_FOR, 1)}, tp AS (SELECT * FROM r10 ORDER BY round(rank, 12) DESC, node LIMIT 50), bo AS (SELECT doc, max(boost) AS boost FROM (SELECT doc, g, sum(rank) AS boost FROM m JOIN tp ON node = e GROUP BY doc, g) GROUP BY doc),
{_RANKED}, w AS (SELECT tg.*, row_number() OVER (ORDER BY round(rrf + 0.3 * coalesce(boost, 0), 9) DESC, place) AS final_place FROM tg LEFT JOIN bo USING (doc) WHERE place <= 3 * target)
SELECT doc, place, final_place, round(least(rrf / (2.0 / 61), 1.0), 4) AS relevance FROM w WHERE final_place <= target""")
def retrieve_graph(t):
    """Three times the target is fetched, boosted by the graph and cut to the target."""
    ranks = graph.top_entities(graph.personalised_pagerank(doc_edges(t), _ASKED_FOR, 10, tolerance=0))
    members = doc_members(t)
    boosts = graph.chunk_boosts(members, ranks, "chunk", "entity")
    found = fusion.reranked(_pool(t, 3), members.select("doc", "chunk").distinct(), boosts)
    return found.select("doc", *longs("place", "final_place"), fusion.normalised(F.col("rrf")).alias("relevance"))


# Ontology and citations


def ontology(t) -> DataFrame:
    """Nodes of all three levels with one path each."""
    n, c = t("nation"), t("customer")
    region = t("region").select(F.col("r_name").alias("ui"), F.array(F.concat(F.lit("R"), "r_regionkey")).alias("paths"))
    path = F.concat(F.lit("R"), "n_regionkey", F.lit(".N"), "n_nationkey")
    nation = n.select(F.col("n_name").alias("ui"), F.array(path).alias("paths"))
    customer = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("ui"), F.array(F.concat(path, F.lit(".C"), "c_custkey")).alias("paths"))
    return region.unionByName(nation).unionByName(customer)


_TREE = """n AS (SELECT r_name AS ui, 'R' || r_regionkey AS path FROM region UNION ALL SELECT n_name, 'R' || n_regionkey || '.N' || n_nationkey FROM nation
UNION ALL SELECT c_name, 'R' || n_regionkey || '.N' || n_nationkey || '.C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
roots AS (SELECT * FROM n WHERE path NOT LIKE '%.C%'), below AS (SELECT DISTINCT r.ui AS root, n.ui FROM roots r JOIN n ON starts_with(n.path, r.path || '.'))"""


@query(f"WITH {_TREE} SELECT root, ui FROM below")
def tree_descendants(t):
    terms = ontology(t)
    return graph.descendants(terms, terms.where(~F.col("paths")[0].contains(".C")), "ui", "paths")


@query(f"WITH {_TREE}, m AS (SELECT * FROM below UNION SELECT ui, ui FROM roots) SELECT root, count(*) AS n, md5(string_agg(ui, ',' ORDER BY ui)) AS h FROM m GROUP BY root")
def tree_expand(t):
    terms = ontology(t)
    found = graph.expand(terms, terms.where(~F.col("paths")[0].contains(".C")), "ui", "paths")
    return found.select("root", F.size("members").cast("long").alias("n"), F.md5(joined("members").cast("binary")).alias("h"))


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 're') ORDER BY p_name LIMIT 10")
def autocomplete(t):
    return graph.autocomplete(t("part"), "p_name", "RE", 10)


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red plate' OR lower(p_brand) = 'red plate' OR lower(p_type) = 'red plate'")
def synonym_lookup(t):
    rows = t("part").withColumn("synonyms", F.array("p_brand", "p_type"))
    return graph.named_or_synonym(rows, "p_name", "synonyms", "Red Plate").select("p_partkey", "p_name")


_CITED = "SELECT c.c_custkey AS citing, s.s_suppkey AS cited, n1.n_name AS citing_nation, n2.n_name AS cited_nation, year(o_orderdate) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey LEFT JOIN nation n1 ON n1.n_nationkey = c.c_nationkey LEFT JOIN nation n2 ON n2.n_nationkey = s.s_nationkey"


def citation_rows(t) -> DataFrame:
    lines, o = t("lineitem").select("l_orderkey", "l_suppkey"), t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    n1, n2 = t("nation").select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("citing_nation")), t("nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("cited_nation"))
    rows = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(n1, F.col("c_nationkey") == F.col("k1"), "left").join(n2, F.col("s_nationkey") == F.col("k2"), "left").select(F.col("c_custkey").alias("citing"), F.col("s_suppkey").alias("cited"), "citing_nation", "cited_nation", "y")


@query(f"SELECT DISTINCT citing, cited, cited_nation FROM ({_CITED})")
def references(t):
    return citation_rows(t).select("citing", "cited", "cited_nation").distinct()


@query(f"SELECT cited, citing, citing_nation, CAST(max(y) AS BIGINT) AS y, row_number() OVER (ORDER BY max(y) DESC, citing) AS place FROM ({_CITED}) WHERE cited = 7 GROUP BY cited, citing, citing_nation")
def cited_by(t):
    """Newest first; the list of one paper's citers."""
    found = citation_rows(t).where("cited = 7").groupBy("cited", "citing", "citing_nation").agg(F.max("y").cast("long").alias("y"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("cited").orderBy(F.desc("y"), "citing")).cast("long"))


# Names and indications

_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({c}), '[a-z0-9]+')]))"


@query(f"""WITH q AS (SELECT {_GRAMS.format(c="'red plaet'")} AS g), n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, {_GRAMS.format(c="p_name")} AS g FROM n)
SELECT p_name, round(len(list_intersect(s.g, q.g)) / len(list_distinct(list_concat(s.g, q.g))), 6) AS similarity FROM s, q WHERE len(list_intersect(s.g, q.g)) / len(list_distinct(list_concat(s.g, q.g))) >= 0.3""")
def trigram_lookup(t):
    return fuzzy.trigram_lookup(t("part"), "p_name", "red plaet").withColumn("similarity", r6("similarity"))


_HITS = "({w} * len([x for x in {t} if x in ('red', 'plate', 'brass')]) / (1.0 + ln(1 + len({t}))))"
_FTS = " + ".join(_HITS.format(w=w, t=TOK.format(c=c)) for c, w in (("p_name", 1.0), ("p_type", 0.4), ("p_brand", 0.2)))


@query(f"SELECT p_partkey, round({_FTS}, 6) AS rank FROM part")
def weighted_fts(t):
    return t("part").select("p_partkey", r6(fuzzy.weighted_rank(["red", "plate", "brass"], F.col("p_name"), F.col("p_type"), F.col("p_brand"))).alias("rank"))


@query("SELECT p_partkey, CASE WHEN lower(p_name || ' ' || p_type) LIKE '%red%plate%' THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit FROM part")
def phrase_boost(t):
    return t("part").select("p_partkey", fuzzy.phrase_hit(["%red%plate%"], F.concat_ws(" ", "p_name", "p_type")).alias("hit"))


@query(f"""WITH s AS (SELECT p_partkey, ({_FTS.replace(", 'brass'", '')}) + 5.0 * CASE WHEN lower(p_name || ' ' || p_type) LIKE '%red%plate%' THEN 1 ELSE 0 END AS rank FROM part WHERE list_has_any({TOK.format(c="p_name || ' ' || p_type || ' ' || p_brand")}, ['red', 'plate']))
SELECT p_partkey, round(rank, 6) AS rank FROM (SELECT * FROM s ORDER BY round(rank, 9) DESC, p_partkey LIMIT 20) WHERE rank >= 0.01 ORDER BY round(rank, 9) DESC, p_partkey LIMIT 10""")
def reverse_lookup(t):
    return fuzzy.reverse_lookup(t("part"), "What is the best drug for red plate?", "p_name", "p_type", "p_brand", "p_partkey", 10).select("p_partkey", r6("rank").alias("rank"))


# Scalar functions

_OPENERS = ["what is", "how do", "why does", "tell me about", "compared to", "define"]
_ASKED = "a AS (SELECT conv_id, turn, o || ' ' || text AS q FROM conversations, (SELECT unnest(['what is', 'how do', 'why does', 'tell me about', 'compared to', 'define']) AS o))"


def asked(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.explode(F.array(*(F.lit(o) for o in _OPENERS))).alias("o"), "text").select("conv_id", "turn", F.concat("o", F.lit(" "), "text").alias("q"))


_COMPARED = r"(^|[^\pL\pN_])(vs|versus|compare (to|with|against)|compared (to|with|against)|better than|worse than|more effective|less effective|difference between|superior to)($|[^\pL\pN_])|(^|[^\pL\pN_])over([^\pL\pN_]).*([^\pL\pN_])or($|[^\pL\pN_])"


@query(rf"""WITH {_ASKED} SELECT CASE WHEN regexp_matches(lower(q), '{_COMPARED}') THEN 'comparative' WHEN starts_with(lower(q), 'what is') OR starts_with(lower(q), 'define') THEN 'factual' ELSE 'exploratory' END AS query_type, count(*) AS n FROM a GROUP BY 1""")
def classify(t):
    return asked(t).select(T.classify(F.col("q")).alias("c")).groupBy("c.query_type").agg(F.count("*").alias("n"))


@query(rf"WITH {_ASKED} SELECT conv_id, turn, o, md5(trim(regexp_replace(q, '(?i)^\s*(what is|how do|why does|tell me about)\s+', ''), ' ?.!,')) AS h FROM (SELECT conv_id, turn, q, substr(q, 1, 6) AS o FROM a)")
def filler_strip(t):
    return asked(t).select("conv_id", "turn", F.substring("q", 1, 6).alias("o"), md5(T.strip_filler(F.col("q"))).alias("h"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'node') AS slug FROM part")
def slug(t):
    return t("part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("WITH s AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN p_brand ELSE '' END AS spec FROM part) SELECT p_partkey, CASE WHEN spec = '' THEN 'extractive' ELSE lower(split_part(spec, '/', 1)) END AS provider, nullif(split_part(spec, '/', 2), '') AS model FROM s")
def provider_spec(t):
    spec = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("/"), "p_type")).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("")
    return t("part").select("p_partkey", T.provider_spec(spec).alias("s")).select("p_partkey", "s.provider", "s.model")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct([lower(w) for w in regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') if regexp_full_match(w, '[a-zA-Z]{4,}')])), ',') AS words FROM documents")
def word_sets(t):
    return t("documents").select("doc_id", joined(F.sort_array(T.word_set(F.col("text")))).alias("words"))


_AUTHORS = "list(s_name ORDER BY l_linenumber, l_suppkey)"


@query(f"SELECT l_orderkey, CASE WHEN count(*) > 2 THEN {_AUTHORS}[1] || ', et al.' ELSE array_to_string({_AUTHORS}, ', ') END AS authors FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey")
def authors_short(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "s_name"))), lambda x: x["s_name"])
    return rows.groupBy("l_orderkey").agg(names.alias("names")).select("l_orderkey", T.authors_short(F.col("names")).alias("authors"))


@query("""WITH h AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS headings FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
a AS (SELECT l_orderkey, string_agg(s_name, ',' ORDER BY l_linenumber, s_name) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o_orderkey, o_orderstatus, headings, names FROM orders LEFT JOIN h ON h.l_orderkey = o_orderkey LEFT JOIN a ON a.l_orderkey = o_orderkey""")
def index_docs(t):
    lines = t("lineitem")
    heads = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(joined(F.sort_array(F.collect_set("p_brand"))).alias("headings"))
    names = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "s_name"))), lambda x: x["s_name"])).alias("names"))
    return t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").join(heads, "l_orderkey", "left").join(names, "l_orderkey", "left").withColumnRenamed("l_orderkey", "o_orderkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_ORCID = "CASE c_custkey % 4 WHEN 0 THEN 'https://orcid.org/0000-0002-1825-009X' WHEN 1 THEN '0000-0001-5109-3700 0000-0002-1694-233X' WHEN 2 THEN '0000-0001' ELSE '' END"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS pmid_ok, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS pmcid_ok,
CASE c_custkey % 4 WHEN 0 THEN '0000-0002-1825-009X' WHEN 1 THEN '0000-0002-1694-233X' END AS orcid FROM customer""")
def id_validators(t):
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    pmid = F.when(m == 0, k).when(m == 1, F.concat(F.lit("x"), k)).otherwise(F.repeat(F.lit("9"), F.lit(21)))
    pmcid = F.concat(F.when(F.col("c_custkey") % 2 == 0, "PMC").otherwise("pmc"), k)
    return t("customer").select("c_custkey", T.valid_pmid(pmid).cast("int").alias("pmid_ok"), T.valid_pmcid(pmcid).cast("int").alias("pmcid_ok"), T.clean_orcid(F.expr(_ORCID)).alias("orcid"))


# Answers

_TWO = "[x for x in [trim(y) for y in string_split(replace(replace(replace(trim(text), '? ', '?|'), '. ', '.|'), '! ', '!|'), '|')] if length(x) > 30]"


@query(f"""WITH c AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
s AS (SELECT source, place, doc_id, array_to_string(({_TWO})[1:2], ' ') AS said FROM c WHERE place <= 5)
SELECT source, md5(string_agg('[' || place || '] ' || said, chr(10) || chr(10) ORDER BY place)) AS h, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY place) AS cited FROM s WHERE said <> '' GROUP BY source""")
def extractive_answer(t):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    found = answer.extractive_answer(t("documents").withColumn("place", place), "source", "place", "doc_id", "text")
    return found.select("source", F.md5(F.col("response").cast("binary")).alias("h"), joined("cited").alias("cited"))


def _answers(t) -> DataFrame:
    """Whole assistant turns, which cite passages 1, 2 and 9 of three at their end."""
    said = F.concat("text", F.lit(" [1][2]. Then [9]."))
    return t("conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer"), said.alias("response"))


def _passages(t, answers: DataFrame) -> DataFrame:
    """(answer, number, item_id, text): three benchmark items dealt to each answer by its number."""
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # the benchmark's items are few
    items = t("benchmark").withColumn("k", place)
    n = items.count()
    asked = answers.select("answer", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("number"))
    return asked.withColumn("k", F.pmod(F.col("answer") * 3 + F.col("number"), F.lit(n))).join(F.broadcast(items), "k").select("answer", "number", "item_id", "text")


_SAID = r"a AS (SELECT conv_id * 100 + turn AS answer, text || ' [1][2]. Then [9].' AS response FROM conversations WHERE role = 'assistant')"
_WORD4 = r"list_distinct([lower(x) for x in regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{N}}_]+') if regexp_full_match(x, '[a-zA-Z]{{4,}}')])"


@query(rf"""WITH {_SAID}, s AS (SELECT answer, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS sentence FROM (SELECT answer, string_split(regexp_replace(response, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM a)),
m AS (SELECT answer, place, sentence, unnest(list_distinct([CAST(y AS BIGINT) for y in regexp_extract_all(sentence, '\[(\d+)\]', 1)])) AS citation FROM s),
w AS (SELECT answer, place, citation, {_WORD4.format(c="replace(sentence, '[' || citation || ']', '')")} AS c FROM m),
i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n, {_WORD4.format(c="text")} AS ws FROM benchmark),
j AS (SELECT w.*, ws FROM w LEFT JOIN i ON citation BETWEEN 1 AND 3 AND (w.answer * 3 + citation) % i.n = i.k)
SELECT answer, place, citation, CASE WHEN citation NOT BETWEEN 1 AND 3 THEN 'invalid' ELSE 'weak' END AS severity FROM j
WHERE citation NOT BETWEEN 1 AND 3 OR len(c) > 0 AND len(ws) > 0 AND len(list_intersect(c, ws)) / len(c) < 0.05""")
def citation_verify(t):
    rows = _answers(t)
    return answer.verify(rows, _passages(t, rows), "answer", "response", "number", "text").select("answer", F.col("place").cast("long"), "citation", "severity")


@query("SELECT conv_id * 100 + turn AS answer, md5(text || ' [2][1]. Then [9].') AS h FROM conversations WHERE role = 'assistant'")
def marker_rewrite(t):
    swap = F.create_map(F.lit(1), F.lit(2), F.lit(2), F.lit(1))
    return _answers(t).select("answer", md5(answer.renumbered(F.col("response"), swap)).alias("h"))


@query("SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER w, '')) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def history_window(t):
    return answer.recent(t("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5(F.array_join("history", "\n").cast("binary")).alias("h"))


@query("SELECT conv_id, turn, md5(CASE role WHEN 'assistant' THEN trim(text, ' ' || chr(10)) ELSE text || ' [3]' END) AS h FROM conversations")
def history_clean(t):
    dirty = F.concat(F.when(F.col("role") == "assistant", F.concat(F.col("text"), F.lit(" [12]\nThis is for information only — please ask.\n"))).otherwise(F.concat("text", F.lit(" [3]"))))
    return t("conversations").select("conv_id", "turn", F.md5(T.clean_history(F.col("role"), dirty).cast("binary")).alias("h"))


# Knowledge graphs


def _relations(t) -> DataFrame:
    """Lines as triples: part name, a predicate by return flag, brand; the order is the graph and cites its line."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    subject = F.when(F.col("l_linenumber") == 5, "Cells").otherwise(F.upper("p_name"))
    predicate = F.when(F.col("l_returnflag") == "A", " Affects ").otherwise(F.concat(F.lit("Flows "), "l_returnflag", F.lit(" by the way")))
    found = rows.select(F.col("l_orderkey").alias("graph"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("at"), subject.alias("subject"), predicate.alias("predicate"), F.col("p_brand").alias("object"), F.array(F.col("l_linenumber").cast("long")).alias("citations"))
    return tables.dealt_as(found, "graph", t("lineitem"))


_REL = "rel AS (SELECT l_orderkey AS graph, CASE WHEN l_linenumber = 5 THEN 'Cells' ELSE upper(p_name) END AS s, p_brand AS o, CASE WHEN l_returnflag = 'A' THEN 'affects' ELSE 'flows ' || lower(l_returnflag) || ' by' END AS pred, l_linenumber AS c FROM lineitem JOIN part ON l_partkey = p_partkey)"
_LAB = "lab AS (SELECT DISTINCT graph, x AS label, lower(x) AS label_lc FROM (SELECT graph, s AS x FROM rel UNION ALL SELECT graph, o FROM rel) WHERE x <> 'Cells' AND NOT (starts_with(x, 'Brand') AND x LIKE '%4'))"
_SLUG = "trim(regexp_replace({c}, '[^a-z0-9]+', '-', 'g'), '-')"
_KG_EDGES = f"ed AS (SELECT rel.graph, {_SLUG.format(c='lower(s)')} AS source, pred AS predicate, {_SLUG.format(c='lower(o)')} AS target, c FROM rel JOIN lab a ON a.graph = rel.graph AND a.label = s JOIN lab b ON b.graph = rel.graph AND b.label = o WHERE pred <> 'affects')"


def _nodes(t) -> DataFrame:
    """The answer's text leaves out the brands that end in 4: relations about them are not grounded."""
    rel = _relations(t)
    said = F.filter(F.array_distinct(F.flatten(F.collect_list(F.array("subject", "object")))), lambda x: ~(F.startswith(x, F.lit("Brand")) & F.endswith(x, F.lit("4"))))
    answers = rel.groupBy("graph").agg(F.array_join(F.array_sort(said), " ").alias("answer"))
    types = rel.where("subject LIKE 'RED%'").select("graph", F.lower("subject").alias("label_lc"), F.lit("DRUG").alias("type")).distinct()
    return kgraph.nodes(rel, answers, "graph", "at", types)


@query(f"WITH {_REL}, {_LAB} SELECT graph, {_SLUG.format(c='label_lc')} AS id, label, label_lc, CASE WHEN starts_with(label_lc, 'red') THEN 'DRUG' ELSE 'OTHER' END AS type FROM lab")
def kg_nodes(t):
    return _nodes(t)


@query(f"WITH {_REL}, {_LAB}, {_KG_EDGES} SELECT graph, source, predicate, target, string_agg(DISTINCT CAST(c AS VARCHAR), ',' ORDER BY CAST(c AS VARCHAR)) AS citations FROM ed GROUP BY ALL")
def kg_edges(t):
    return kgraph.edges(_relations(t), _nodes(t), "graph", "at").select("graph", "source", "predicate", "target", joined("citations").alias("citations"))


@query(f"""WITH {_REL}, {_LAB}, {_KG_EDGES}, tc AS (SELECT graph, source AS id, c FROM ed UNION SELECT graph, target, c FROM ed)
SELECT tc.graph, id, label, CASE WHEN starts_with(label_lc, 'red') THEN 'DRUG' ELSE 'OTHER' END AS type, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS citations FROM tc JOIN lab ON lab.graph = tc.graph AND {_SLUG.format(c='label_lc')} = id GROUP BY ALL""")
def kg_assembly(t):
    """Nodes that an edge touches, with the citations of their edges."""
    nodes = _nodes(t)
    found = kgraph.connected(nodes, kgraph.edges(_relations(t), nodes, "graph", "at"), "graph")
    return found.select("graph", "id", "label", "type", joined("citations").alias("citations"))


@query(f"""WITH {_REL}, {_LAB}, {_KG_EDGES}, n AS (SELECT graph, count(*) AS n FROM ed GROUP BY graph), g AS (SELECT graph, count(*) AS lines FROM rel GROUP BY graph)
SELECT graph, CASE WHEN n > 0 THEN NULL WHEN lines >= 6 THEN 'truncated input' ELSE 'no relations' END AS diagnosis FROM g LEFT JOIN n USING (graph)""")
def kg_diagnosis(t):
    """Orders of six lines or more have an answer over the cap."""
    n = kgraph.edges(_relations(t), _nodes(t), "graph", "at").groupBy("graph").agg(F.count("*").alias("n"))
    long = F.when(F.count("*") >= 6, F.repeat(F.lit("x"), F.lit(kgraph.ANSWER_CAP + 1))).otherwise("x")
    return _relations(t).groupBy("graph").agg(long.alias("answer")).join(n, "graph", "left").select("graph", kgraph.diagnosis(F.col("answer"), F.coalesce("n", F.lit(0))).alias("diagnosis"))


@query(f"WITH {_REL}, {_LAB}, {_KG_EDGES} SELECT graph, source, predicate, target FROM ed WHERE source LIKE '%red%' AND target LIKE '%brand-2%' GROUP BY ALL")
def kg_search(t):
    """Edges whose ends both match, the label being searched for ``red`` or ``brand#2``."""
    nodes = _nodes(t)
    found = kgraph.edges(_relations(t), nodes, "graph", "at")
    key = lambda df, c: df.withColumn(c, F.concat_ws("|", "graph", c))
    hits = key(nodes, "id").where(F.contains("label_lc", F.lit("red")) | F.contains("label_lc", F.lit("brand#2")))
    kept = kgraph.induced(key(key(found, "source"), "target"), hits, "")
    return kept.select("graph", F.substring_index("source", "|", -1).alias("source"), "predicate", F.substring_index("target", "|", -1).alias("target"))


_HALF = "SELECT p_name AS id, p_name || repeat('x', CAST(min(p_size) AS INTEGER)) AS label, CASE WHEN min(p_size) < 5 THEN 'OTHER' ELSE 'GENE' END AS type, list(DISTINCT p_size) AS c FROM part WHERE p_partkey % 2 = {k} GROUP BY p_name"


@query(f"""WITH a AS ({_HALF.format(k=0)}), b AS ({_HALF.format(k=1)}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN length(coalesce(b.label, '')) > length(coalesce(a.label, '')) THEN b.label ELSE a.label END AS label,
CASE WHEN 'GENE' IN (a.type, b.type) THEN 'GENE' ELSE 'OTHER' END AS type, CAST(len(list_distinct(list_concat(coalesce(a.c, []), coalesce(b.c, [])))) AS BIGINT) AS n FROM a FULL JOIN b ON a.id = b.id""")
def kg_merge(t):
    def half(k: int) -> DataFrame:
        g = t("part").where(f"p_partkey % 2 = {k}").groupBy(F.col("p_name").alias("id")).agg(F.min("p_size").alias("m"), F.collect_set("p_size").alias("citations"))
        return g.select("id", F.concat("id", F.repeat(F.lit("x"), F.col("m"))).alias("label"), F.when(F.col("m") < 5, "OTHER").otherwise("GENE").alias("type"), "citations")

    return kgraph.merge_nodes(half(0), half(1)).select("id", "label", "type", F.size("citations").cast("long").alias("n"))


_CANON = "regexp_replace({c}, '[0-9]$', 'x')"
_EDGE_HALF = "SELECT p_name AS source, lower(p_type) AS predicate, p_brand AS target, list(DISTINCT p_size) AS c FROM part WHERE p_partkey % 2 = {k} AND p_brand <> 'Brand#11' GROUP BY ALL"


@query(f"""WITH a AS ({_EDGE_HALF.format(k=0)}), b AS ({_EDGE_HALF.format(k=1)}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT source, predicate, target, array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS citations FROM u GROUP BY source, predicate, target""")
def kg_merge_edges(t):
    """Equal edges unite their citations; an edge with an end that the session does not know is dropped."""
    def half(k: int) -> DataFrame:
        return t("part").where(f"p_partkey % 2 = {k}").groupBy(F.col("p_name").alias("source"), F.lower("p_type").alias("predicate"), F.col("p_brand").alias("target")).agg(F.collect_set("p_size").alias("citations"))

    known = t("part").select(F.col("p_name").alias("id")).union(t("part").where("p_brand <> 'Brand#11'").select("p_brand")).distinct()
    return kgraph.merge_edges(half(0), half(1), known).select("source", "predicate", "target", joined("citations").alias("citations"))


@query(f"WITH {_REL}, e AS (SELECT DISTINCT lower(s) AS source, pred AS predicate, {_CANON.format(c='lower(o)')} AS target, c FROM rel) SELECT source, predicate, target, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS citations FROM e GROUP BY ALL")
def kg_apply_groups(t):
    predicate = F.array_join(F.slice(F.split(F.lower(F.trim("predicate")), " "), 1, 3), " ")
    rel = _relations(t).select(F.lower("subject").alias("source"), predicate.alias("predicate"), F.lower("object").alias("target"), "citations")
    brands = t("part").select(F.lower("p_brand").alias("label")).distinct().withColumn("canonical", F.regexp_replace("label", "[0-9]$", "x"))
    return kgraph.redirect(rel, brands).select("source", "predicate", "target", joined("citations").alias("citations"))


@query("SELECT p_brand AS grp, min(p_name) AS canonical, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS members FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue') GROUP BY p_brand HAVING count(DISTINCT p_name) >= 2")
def kg_groups(t):
    """Proposed groups hold all names of a brand; only red and blue ones are labels of the graph."""
    rows = t("part").select(F.col("p_brand").alias("grp"), F.upper("p_name").alias("member"), F.col("p_name").alias("order_key"))
    known = t("part").where("p_name LIKE 'red%' OR p_name LIKE 'blue%'")
    low = known.groupBy(F.col("p_brand").alias("grp")).agg(F.upper(F.min("p_name")).alias("canonical"))
    found = kgraph.valid_groups(rows.join(low, "grp"), known.select(F.col("p_name").alias("label")), "grp", "order_key", "member", "canonical")
    return found.select("grp", "canonical", joined(F.sort_array("members")).alias("members"))


@query("""SELECT p_partkey, CAST(3 AS BIGINT) AS n, p_partkey % 2 = 1 AS truncated, repeat('a {' || p_name || '|b"}|c|1,2;', 3) AS relations FROM part""")
def json_salvage(t):
    one = F.concat(F.lit('{"subject": "a {'), F.col("p_name"), F.lit('", "predicate": "b\\"}", "object": "c", "citations": [1, 2]}'))
    whole = F.concat(F.lit('Sure:\n```json\n{"relations": ['), F.array_join(F.array_repeat(one, 3), ", "))
    raw = F.concat(whole, F.when(F.col("p_partkey") % 2 == 1, ', {"subject": "cut of').otherwise("]}\n```"))
    flat = F.array_join(F.transform("s.relations", lambda r: F.concat_ws("|", r["subject"], r["predicate"], r["object"], F.concat(joined(r["citations"]), F.lit(";")))), "")
    return t("part").select("p_partkey", kgraph.salvage(raw).alias("s")).select("p_partkey", F.size("s.relations").cast("long").alias("n"), "s.truncated", flat.alias("relations"))


_LABEL = "p_name || ' ' || p_type || ' ' || p_brand"


@query(f"WITH n AS (SELECT DISTINCT {_LABEL} AS label FROM part), w AS (SELECT label, list_distinct({TOK.format(c='label')}) AS w FROM n) SELECT x.label AS a, y.label AS b FROM w x JOIN w y ON x.label < y.label WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.7")
def jaccard_dups(t):
    labels = t("part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label")).distinct()
    return fuzzy.similar_pairs(labels, "label", lexical.tokens(F.col("label")), 0.7).select("a", "b")


_TITLES = ", ".join(f"('{k}', '{v}')" for k, v in T.SECTIONS.items())
_BARE = r"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS h, regexp_split_to_array(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS x FROM pages),
s AS (SELECT page_id, i, h[i] AS head, x[i + 1] AS body FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM p)), k(title, kind) AS (VALUES {_TITLES})
SELECT page_id, CAST(i - 1 AS BIGINT) AS place, CAST(regexp_extract(head, '(?i)<h([1-6])', 1) AS BIGINT) AS level, {_BARE.format(c='head')} AS title, coalesce(kind, 'other') AS section_type, md5({_BARE.format(c='body')}) AS h
FROM s LEFT JOIN k ON k.title = rtrim(lower({_BARE.format(c='head')}), '.')""")
def heading_sections(t):
    found = t("pages").select("page_id", F.posexplode(records.html_sections(F.col("html"))).alias("place", "s"))
    return found.select("page_id", F.col("place").cast("long"), F.col("s.level").cast("long").alias("level"), "s.title", "s.section_type", md5("s.text").alias("h"))


# Queue, cache and table state


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def latest_state(t):
    return state.latest_state(t("events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, CASE WHEN status IN ('click', 'view') AND ts < {_AS_OF} - INTERVAL 60 MINUTE THEN 'queued' ELSE status END AS status, status IN ('click', 'view') AND ts < {_AS_OF} - INTERVAL 60 MINUTE AS reset FROM s")
def stale_reset(t):
    states = state.latest_state(t("events"), "user_id", "event_type", ["ts", "event_id"])
    return state.reset_stale(states, F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), ("click", "view")).select("user_id", "status", "reset")


@query("WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, ts FROM s WHERE status = 'click' ORDER BY ts, user_id LIMIT 20")
def queue_claim(t):
    states = state.latest_state(t("events"), "user_id", "event_type", ["ts", "event_id"])
    return state.claim(states, "user_id", "click", 20).select("user_id", "ts")


_SEC = "epoch(ts)"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_SEC} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, s, n, false AS hit, s AS filled FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.s, o.n, o.s < r.filled + 43200, CASE WHEN o.s < r.filled + 43200 THEN r.filled ELSE o.s END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, hit FROM r""")
def key_cache_replay(t):
    rows = t("events").withColumn("s", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts")) / 1e6)
    return state.cache_replay(rows, "user_id", "s", "event_id", 43200)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type IN ('click', 'view', 'purchase') AS take, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, take AS granted, CASE WHEN take THEN 1 ELSE 0 END AS held FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.take THEN r.held < 3 ELSE r.held > 0 END, r.held + CASE WHEN o.take AND r.held < 3 THEN 1 WHEN NOT o.take AND r.held > 0 THEN -1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, granted, CAST(held AS BIGINT) AS held FROM r""")
def key_slots(t):
    rows = t("events").withColumn("action", F.when(F.col("event_type").isin("click", "view", "purchase"), "acquire").otherwise("release"))
    return state.slot_replay(rows, "user_id", "action", "event_id").withColumn("held", F.col("held").cast("long"))


@query("WITH g AS (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT event_id, coalesce(d < INTERVAL 3600 SECOND, false) AS throttled FROM g")
def throttle_gaps(t):
    return state.gaps(t("events"), "user_id", "ts", "event_id", 3600).select("event_id", "throttled")


_OLD, _NEW = "o_orderkey % 2 = 0 OR o_orderkey % 5 = 0", "o_orderkey % 2 = 1"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def upsert_latest(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return upserts.upsert(o.where(_OLD).withColumn("v", F.lit(1)), o.where(_NEW).select("o_orderkey", (F.col("price") + 1).alias("price"), F.lit(2).alias("v")), ["o_orderkey"], "v").select("o_orderkey", "price")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price FROM orders")
def insert_ignore(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return upserts.insert_ignore(o.where(_OLD), o.where(_NEW).select("o_orderkey", (F.col("price") + 1).alias("price")), ["o_orderkey"], "price")


@query("WITH f AS (SELECT c_nationkey AS k, arg_min(c_mktsegment, c_custkey) AS m FROM customer GROUP BY 1) SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE m END AS filled FROM supplier LEFT JOIN f ON k = s_nationkey")
def fill_missing(t):
    rows = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, F.lit("  ")).alias("filled"))
    siblings = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("filled"), "c_custkey")
    return upserts.fill_missing(rows, siblings, "k", ["filled"], "c_custkey").select("s_suppkey", "filled")


@query("SELECT d.doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti(t):
    return tables.pending(t("documents").select("doc_id", "n_chars"), t("labels"), "doc_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size >= 50)")
def target_semi(t):
    hits = t("lineitem").join(t("part").where("p_size >= 50"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"))
    return t("supplier").join(hits, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax < 0.01 THEN NULL ELSE l_extendedprice END AS value FROM lineitem WHERE l_quantity >= 6 AND (l_tax < 0.01 OR l_extendedprice <= 10000)")
def activity_filter(t):
    rows = t("lineitem").withColumn("value", F.when(F.col("l_tax") >= 0.01, F.col("l_extendedprice")))
    return tables.activity_filter(rows, "value", "l_quantity", 6, 10000).select("l_orderkey", "l_linenumber", "l_partkey", "value")


@query("SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM documents WHERE n_chars > 2000) AS with_full_text, (SELECT count(*) FROM labels) AS labels, (SELECT count(DISTINCT source) FROM documents) AS sources")
def stats(t):
    d = t("documents").agg(F.count("*").alias("papers"), F.count_if(F.col("n_chars") > 2000).alias("with_full_text"), F.count_distinct("source").alias("sources"))
    return d.crossJoin(t("labels").agg(F.count("*").alias("labels"))).select("papers", "with_full_text", "labels", "sources")


@query("SELECT user_id, max(ts) AS created FROM events GROUP BY user_id HAVING epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(max(ts)) < 86400 ORDER BY created DESC, user_id DESC LIMIT 40")
def live_jobs(t):
    jobs = t("events").groupBy("user_id").agg(F.max("ts").alias("created"))
    return state.live_jobs(jobs, "user_id", "created", F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), 86400, 40)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(t):
    return state.windowed_counts(t("events"), "ts", "event_type", "1 day")


@query("WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL (12 * k) HOUR AS window_start, event_type FROM events, (SELECT unnest([0, 1]) AS k)) SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL")
def window_sliding(t):
    return state.windowed_counts(t("events"), "ts", "event_type", "24 hours", "12 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(t):
    return state.sessions(t("events"), "user_id", "ts", "6 hours")


_IN = "(SELECT sum(n) FROM d WHERE day BETWEEN a AND b)"


@query(f"""WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), r(a, b) AS (SELECT min(day), max(day) FROM d UNION ALL
SELECT CASE WHEN h = 0 THEN a ELSE m + 1 END, CASE WHEN h = 0 THEN m ELSE b END FROM (SELECT a, b, a + CAST((b - a) // 2 AS INTEGER) AS m FROM r WHERE a < b AND {_IN} > 300), (SELECT unnest([0, 1]) AS h))
SELECT a AS date_from, b AS date_to, CAST(least(n, 300) AS BIGINT) AS n, n > 300 AS truncated FROM (SELECT a, b, {_IN} AS n FROM r) WHERE n > 0 AND (n <= 300 OR a = b)""")
def date_windows(t):
    daily = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return t.spark.createDataFrame(tables.split_windows(daily, 300), "date_from date, date_to date, n long, truncated boolean")


# The other modules register their queries when they are imported; some build on what stands above.
from siltstone.plans import commit_queries, ingest_queries, lookup_queries, record_queries, search_queries  # noqa: E402, F401
from siltstone.plans import stream_queries  # noqa: E402, F401  (takes oracles of the modules above)
from siltstone.plans import detail_queries  # noqa: E402, F401
