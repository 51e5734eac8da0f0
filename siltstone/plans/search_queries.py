"""Registered queries over kept search structures: small-world graphs and postings with positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import covers, fuzzy, smallworld
from siltstone.operators.lexical import STOP_WORDS
from siltstone.plans.registry import query, r6

# Small worlds


def worlds(t):
    """The graphs over all embeddings, written by the first query that needs them and read by later ones."""
    return t.kept("small-worlds", lambda: smallworld.small_worlds(t("embeddings"), "vec_id", "embedding"))


_ASKED = "q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL), s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS sim FROM q, embeddings WHERE embedding IS NOT NULL AND vec_id <> query)"


def asked(t):
    return t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


@query(f"WITH {_ASKED} SELECT query, CAST(least(20, count(*)) AS BIGINT) AS n_found, round(max(sim), 6) AS best, TRUE AS recall_reached FROM s GROUP BY query")
def hnsw_topk(t):
    """Of every fiftieth vector the twenty nearest by beams; whether 0.95 of those of a full scan are among them."""
    rows = smallworld.beam_topk(worlds(t), asked(t), 20, measure=True)
    hits, n = F.count_if(F.col("found") & F.col("exact")), F.count_if("exact")
    best = F.max(F.when(F.col("found"), F.col("similarity")))
    return rows.groupBy("query").agg(F.count_if("found").alias("n_found"), r6(best).alias("best"), (hits >= 0.95 * n).alias("recall_reached"))


# Full-text rank by cover density

_COVERED = ["er", "from", "en"]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _vector_sql(table: str, key: str, fields: list[tuple[str, str]]) -> str:
    """(doc, term, class, pos) by DuckDB: words of the fields in order; a field counts on from the last word that is no stop word."""
    words = ", ".join(f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS t{k}" for k, (_, text) in enumerate(fields))
    last = lambda k: f"coalesce(list_max([CASE WHEN t{k}[i] NOT IN ({_STOP}) THEN i ELSE 0 END for i in range(1, len(t{k}) + 1)]), 0)"
    each = " UNION ALL ".join(
        f"SELECT doc, '{c}' AS class, unnest(t{k}) AS term, generate_subscripts(t{k}, 1) + {' + '.join(['0'] + [last(j) for j in range(k)])} AS pos FROM words" for k, (c, _) in enumerate(fields)
    )
    return f"words AS (SELECT {key} AS doc, {words} FROM {table}), post AS (SELECT * FROM ({each}) WHERE term NOT IN ({_STOP}))"


_WEIGHT = "CASE class WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END"


def _covers_sql(terms: list[str]) -> str:
    """Covers as the runs from hit to hit that hold all terms and in which no shorter run between hits does."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""h AS (SELECT doc, term, pos, {_WEIGHT} AS w FROM post WHERE term IN ({listed})),
    m AS (SELECT doc FROM h GROUP BY doc HAVING count(DISTINCT term) = {len(terms)}),
    r AS (SELECT a.doc, a.pos AS p, min(b.q) AS q FROM h a JOIN (SELECT x.doc, x.pos AS p, y.pos AS q FROM h x JOIN h y ON x.doc = y.doc AND y.pos >= x.pos JOIN h z ON z.doc = x.doc AND z.pos BETWEEN x.pos AND y.pos
      WHERE x.doc IN (SELECT doc FROM m) AND y.pos - x.pos <= 20000 GROUP BY x.doc, x.pos, y.pos HAVING count(DISTINCT z.term) = {len(terms)}) b ON a.doc = b.doc AND a.pos = b.p GROUP BY a.doc, a.pos),
    c AS (SELECT doc, max(p) AS p, q FROM r GROUP BY doc, q),
    d AS (SELECT c.doc, c.p, c.q, count(*) AS n, count(*) / sum(1 / w) / (1 + (c.q - c.p) - (count(*) - 1)) AS density FROM c JOIN h ON h.doc = c.doc AND h.pos BETWEEN c.p AND c.q GROUP BY c.doc, c.p, c.q)"""


#: A document's first line is its title.
_TITLED = [("A", "split_part(text, chr(10), 1)"), ("B", "substr(text, length(split_part(text, chr(10), 1)) + 1)")]
_PART_FIELDS = [("A", "p_name"), ("B", "p_type"), ("C", "p_brand")]


def titled(t):
    """Postings with positions of the documents, title A and rest B; written by the first query that needs them."""
    title = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(title) + 1, F.length("text"))
    return t.kept("titled-positions", lambda: covers.positions(t("documents"), "doc_id", {"title": ("A", title), "rest": ("B", rest)}), "bucket")


@query(f"WITH {_vector_sql('documents', 'doc_id', _TITLED)}, {_covers_sql(_COVERED)} SELECT doc, count(*) AS n_covers, min(q - p + 1) AS shortest, round(sum(density), 6) AS rank FROM d GROUP BY doc")
def cover_rank(t):
    """Every document that holds three terms, by the density of its covers."""
    found = covers.covers(covers.hits(titled(t), _COVERED), _COVERED)
    return found.groupBy("doc").agg(F.count("*").alias("n_covers"), F.min(F.col("last") - F.col("first") + 1).cast("long").alias("shortest"), r6(F.sum("density")).alias("rank"))


@query(f"WITH {_vector_sql('documents', 'doc_id', _TITLED)}, {_covers_sql(_COVERED[:2])}, s AS (SELECT doc, sum(density) AS rank FROM d GROUP BY doc) SELECT doc, round(rank, 6) AS rank FROM s ORDER BY round(rank, 9) DESC, doc LIMIT 20")
def weighted_vector_search(t):
    """The twenty best papers by the weighted vector of title and abstract."""
    return covers.best(covers.cover_rank(titled(t), _COVERED[:2]), 20).select("doc", r6("rank").alias("rank"))


def labels(t):
    fields = {c: (w, F.col(c)) for w, c in _PART_FIELDS}
    return t.kept("label-positions", lambda: covers.positions(t("part"), "p_partkey", fields), "bucket")


_ASKED_OF = ["red", "plate", "brass"]


@query(f"""WITH {_vector_sql('part', 'p_partkey', _PART_FIELDS)}, s AS (SELECT doc, sum({_WEIGHT}) AS fts FROM post WHERE term IN ('red', 'plate', 'brass') GROUP BY doc),
x AS (SELECT doc, fts + 5.0 * CASE WHEN lower(p_name || ' ' || p_type) LIKE '%red%plate%' THEN 1 ELSE 0 END AS rank FROM s JOIN part ON p_partkey = doc)
SELECT doc AS p_partkey, round(rank, 6) AS rank FROM x WHERE rank >= 0.01 ORDER BY round(rank, 9) DESC, doc LIMIT 10""")
def indication_rank(t):
    """Labels by any of the terms, classes A, B and C, with five more for a phrase."""
    ranked = covers.cover_rank(labels(t), _ASKED_OF, every=False)
    phrase = t("part").select(F.col("p_partkey").alias("doc"), fuzzy.phrase_hit(["%red%plate%"], F.concat_ws(" ", "p_name", "p_type")).alias("hit"))
    ranked = ranked.join(phrase, "doc").select("doc", (F.col("rank") + 5.0 * F.col("hit")).alias("rank"))
    return covers.best(ranked, 10, 0.01).select(F.col("doc").alias("p_partkey"), r6("rank").alias("rank"))
