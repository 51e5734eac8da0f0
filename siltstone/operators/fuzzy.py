"""Name resolution: trigram similarity, weighted full-text rank, phrase boost, forward and reverse look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import content_terms, drug_shaped, phrase_patterns
from siltstone.operators.lexical import tokens

GATE, ACCEPT, PHRASE, LEAST_RANK = 0.3, 0.5, 5.0, 0.01
# Weights of the rank classes A, B and C.
WEIGHTS = {"a": 1.0, "b": 0.4, "c": 0.2}


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 without any."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similar_pairs(rows: DataFrame, key: str, words: Column, least: float) -> DataFrame:
    """(a, b, similarity) of keys whose word sets have a Jaccard similarity of ``least`` or more, a < b.

    Words are ordered from rare to frequent; two such sets share a word among the first n - ceil(least * n) + 1 of each, so
    only these meet, and the frequent words hardly ever do.
    """
    sets = rows.select(key, F.array_distinct(words).alias("w")).where(F.size("w") > 0)
    counts = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ordered = sets.select(key, F.explode("w").alias("word")).join(counts, "word").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("w"))
    kept = F.slice("w", F.lit(1), F.size("w") - F.ceil(least * F.size("w") - 1e-9).cast("int") + 1)
    posted = ordered.select(key, "w", F.explode(kept).alias("word"))
    a, b = posted.toDF("a", "wa", "word"), posted.toDF("b", "wb", "word")
    near = (F.size("wa") >= least * F.size("wb")) & (F.size("wb") >= least * F.size("wa"))
    met = a.join(b, "word").where((F.col("a") < F.col("b")) & near).select("a", "b", "wa", "wb").distinct()
    return met.select("a", "b", similarity(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)


def trigram_lookup(names: DataFrame, name: str, wanted: str, gate: float = GATE) -> DataFrame:
    """(name, similarity) of the distinct names that pass the gate, best first."""
    query = trigrams(F.lit(wanted))
    scored = names.select(name).distinct().withColumn("similarity", similarity(trigrams(F.col(name)), query))
    return scored.where(F.col("similarity") >= gate)


def lookup(names: DataFrame, name: str, brands: str | None, wanted: str) -> DataFrame:
    """The row of that exact name or brand, else the best of similarity ``ACCEPT`` or more; at most one row."""
    exact = F.lower(name) == wanted.lower()
    if brands:
        exact = exact | F.coalesce(F.exists(brands, lambda b: F.lower(b) == wanted.lower()), F.lit(False))
    scored = names.withColumn("similarity", F.when(exact, F.lit(2.0)).otherwise(similarity(trigrams(F.col(name)), trigrams(F.lit(wanted)))))
    return scored.where(F.col("similarity") >= ACCEPT).orderBy(F.desc("similarity"), name).limit(1)


def weighted_rank(terms: list[str], a: Column, b: Column, c: Column) -> Column:
    """Weighted hits of any of the terms over the three classes, damped by each class's length."""
    part = lambda text, w: w * F.size(F.filter(tokens(text), lambda t: t.isin(terms))) / (1.0 + F.log1p(F.size(tokens(text))))
    return part(a, WEIGHTS["a"]) + part(b, WEIGHTS["b"]) + part(c, WEIGHTS["c"])


def phrase_hit(patterns: list[str], text: Column) -> Column:
    """1.0 if the lower-cased text is LIKE one of the patterns."""
    return F.when(F.exists(F.array(*(F.lit(p) for p in patterns)).cast("array<string>"), lambda p: F.like(F.lower(text), p)), 1.0).otherwise(0.0)


def reverse_lookup(rows: DataFrame, query: str, a: str, b: str, c: str, key: str, n: int = 3) -> DataFrame:
    """The n rows that best fit a described indication: twice n by rank, then those of ``LEAST_RANK`` or more."""
    spark = rows.sparkSession
    probe = spark.range(1).select(content_terms(F.lit(query)).alias("t")).select("t", phrase_patterns(F.col("t")).alias("p")).first()
    terms, patterns = list(probe["t"]), list(probe["p"])
    base = weighted_rank(terms, F.col(a), F.col(b), F.col(c))
    found = rows.withColumn("rank", base + PHRASE * phrase_hit(patterns, F.concat_ws(" ", a, b))).where(F.size(F.filter(tokens(F.concat_ws(" ", a, b, c)), lambda t: t.isin(terms))) > 0)
    return found.orderBy(F.desc(F.round("rank", 9)), key).limit(2 * n).where(F.col("rank") >= LEAST_RANK).orderBy(F.desc(F.round("rank", 9)), key).limit(n)


def candidate_names(queries: DataFrame, text: str, stop: list[str]) -> DataFrame:
    """The query rows with candidates: distinct lower-case words of a drug's shape outside the stop list, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z\-]+)"), F.lit(1))
    return queries.withColumn("candidates", F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(stop) & drug_shaped(w)))))


def by_priority(*found: DataFrame, key: str, n: int) -> DataFrame:
    """The first n distinct keys over several look-ups, earlier look-ups first."""
    every = None
    for k, df in enumerate(found):
        part = df.select(key).withColumn("source", F.lit(k))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(key).agg(F.min("source").alias("source"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("source", key))).where(F.col("place") <= n)
