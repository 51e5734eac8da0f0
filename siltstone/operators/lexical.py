"""Lexical retrieval: kept postings, BM25 over one or several fields, filters that do not score.

An index is postings (bucket, term, field, doc, tf, len) and statistics (field, n, mean).  Written once, partitioned by the
term's bucket and sorted by term, a search reads only the buckets of its terms, and of these the row groups that hold them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import text_tasks

K1, B, BUCKETS = 1.2, 0.75, 16
# English stop words of the analyser.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
]


@dataclass
class Index:
    postings: DataFrame
    stats: DataFrame


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def analysed(text: Column, stop: bool = True, stem=None) -> Column:
    """Tokens without stop words, stemmed by ``stem`` (array column to array column) if given."""
    found = F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS)) if stop else tokens(text)
    return stem(found) if stem else found


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _by_field(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("tokens")) for f, c in fields.items())))
    return docs.select(F.col(id_col).alias("doc"), listed.alias("x")).select("doc", "x.*")


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(bucket, term, field, doc, tf, len), clustered by bucket and sorted by term: as it is to be written."""
    # Tokens are counted where their document is: sorted, a term is a run.  Its rows stay in that task, which is bounded by its
    # documents' tokens, so a frequent term does not land in one and nothing but texts is exchanged.
    joined = docs.select(F.col(id_col).alias("doc"), *(F.array_join(c, " ").alias(f) for f, c in fields.items()))
    docs = joined.repartition(text_tasks(docs), "doc")
    split = {f: F.filter(F.split(f, " "), lambda t: t != "") for f in fields}
    rows = _by_field(docs, "doc", split).where(F.size("tokens") > 0).select("doc", "field", F.size("tokens").alias("len"), F.array_sort("tokens").alias("s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    runs = rows.select("doc", "field", "len", "s", starts.alias("at"))
    run = F.transform("at", lambda p, k: F.struct(F.get("s", p).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("len")) - p).cast("long").alias("tf")))
    counted = runs.select("doc", "field", "len", F.explode(run).alias("r")).select("doc", "field", "len", "r.term", "r.tf", bucket_of(F.col("r.term")).alias("bucket"))
    return counted.sortWithinPartitions("bucket", "term").select("term", "field", "doc", "tf", "len", "bucket")


def statistics(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(field, n, mean): documents and mean length, a row a field."""
    return _by_field(docs, id_col, fields).groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))


def index(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> Index:
    """An index that is computed where it is used."""
    return Index(postings(docs, id_col, fields), statistics(docs, id_col, fields))


def bm25(found: Index, terms: DataFrame, boosts: dict[str, float] | None = None, k1: float = K1, b: float = B, blend: bool = False) -> DataFrame:
    """(doc, term, score): a document's best boosted field for each term it has; sum over terms is its BM25 score.

    ``terms`` is (term, times), the few terms of a query; a repeated term counts as often.  Document frequencies and mean
    lengths are those of the whole index, whatever filters a caller applies to the result; documents without any of the
    terms are absent.  With ``blend`` a term's frequency is the largest of its fields', so that a field in which the term is
    rare by accident does not outweigh the others.
    """
    boost = F.create_map(*(F.lit(x) for kv in (boosts or {}).items() for x in kv)) if boosts else None
    terms = terms.withColumn("bucket", bucket_of(F.col("term")))
    # The terms of one query are few; the bucket prunes partitions and the term row groups.
    hits = found.postings.join(F.broadcast(terms), ["bucket", "term"])
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    if blend:
        df = df.join(df.groupBy("term").agg(F.max("df").alias("most")), "term").select("field", "term", F.col("most").alias("df"))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(found.stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) * F.col("times")
    weight = F.coalesce(F.try_element_at(boost, F.col("field")), F.lit(1.0)) if boosts else F.lit(1.0)
    return scored.groupBy("doc", "term").agg(F.max(score * weight).alias("score"))


def search(found: Index, terms: list[str] | DataFrame, top: int | None = None, boosts: dict[str, float] | None = None, least_share: float = 0.0, allowed: DataFrame | None = None, blend: bool = False) -> DataFrame:
    """(doc, score, matched), best first, ties by doc.

    ``terms`` is a list, or (term, times) of any origin.  ``least_share`` of the distinct terms, rounded down, must match;
    ``allowed`` (doc) filters without scoring.
    """
    post = found.postings
    if isinstance(terms, list):
        wanted = list(dict.fromkeys(terms))
        spark = post.sparkSession
        post = post.where(F.col("bucket").isin([zlib.crc32(t.encode()) % BUCKETS for t in wanted]) & F.col("term").isin(wanted))
        listed = F.array(*(F.lit(t) for t in wanted)).cast("array<string>")
        terms = spark.range(1).select(F.explode(listed).alias("term"), F.lit(1).alias("times"))
    per_term = bm25(Index(post, found.stats), terms, boosts, blend=blend)
    scored = per_term.groupBy("doc").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    if least_share:
        scored = scored.crossJoin(F.broadcast(terms.agg(F.count("*").alias("n_terms")))).where(F.col("matched") >= F.floor(F.col("n_terms") * least_share)).drop("n_terms")
    if allowed is not None:
        scored = scored.join(allowed, "doc", "left_semi")
    return scored.orderBy(F.desc(F.round("score", 9)), "doc").limit(top) if top else scored


def terms_of(docs: DataFrame, text: Column) -> DataFrame:
    """(term, times) of the texts of ``docs``, as a query."""
    return docs.select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


def highlight(text: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with each of the terms marked, whole words, case ignored."""
    return F.regexp_replace(text, rf"(?i)(?<![a-z0-9])({'|'.join(terms)})(?![a-z0-9])", f"{before}$1{after}")


def fragments(text: Column, terms: list[str], size: int = 200, most: int = 2) -> Column:
    """The ``most`` windows of ``size`` characters with the most hits, best first."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    windows = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    scored = F.transform(windows, lambda w, i: F.struct((-F.size(F.filter(tokens(w), lambda t: t.isin(terms)))).alias("rank"), i.alias("at"), w.alias("text")))
    return F.transform(F.slice(F.filter(F.array_sort(scored), lambda s: s["rank"] < 0), 1, most), lambda s: highlight(s["text"], terms))
