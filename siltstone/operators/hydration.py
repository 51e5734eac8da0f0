"""What a result list is shown with: papers, journals and authors of its chunks, facets, lists with conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import dealt_as


def hydrated(chunks: DataFrame, papers: DataFrame, journals: DataFrame, links: DataFrame, authors: DataFrame, paper: str, journal: str, author: str, position: str, name: str) -> DataFrame:
    """``chunks`` with the columns of their paper, its journal's (null if unknown) and ``authors``: names by position.

    A chunk without a paper goes; a paper without journal or authors stays.  Authors that have no row are left out, of a
    link that repeats one counts.  Names are listed once a paper, and only for papers that have a chunk here.  All is dealt by
    the paper to as many tasks as the links need, so what a task sorts does not grow with the tables.
    """
    chunks, papers, links = (dealt_as(rows, paper, links) for rows in (chunks, papers, links))
    wanted = chunks.select(paper).distinct()
    held = links.join(wanted, paper, "left_semi").select(paper, author, position).distinct().join(authors.select(author, name), author)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(position, author, name))), lambda a: a[name])
    named = held.groupBy(paper).agg(listed.alias("authors"))
    about = papers.join(wanted, paper, "left_semi").join(journals, journal, "left").join(named, paper, "left")
    return chunks.join(about.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))), paper)


def parents_found(found: DataFrame, parent: str, place: str) -> DataFrame:
    """(``parent``, ``place``) of a ranked list of rows: each parent once, at its first place."""
    return found.groupBy(parent).agg(F.min(place).alias(place))


def facets(found: DataFrame, parent: str, place: str, about: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, first): how many distinct parents of a result list have a value, and the best place of one.

    ``about`` has a row a parent with ``fields``; a null value counts as one of its own.
    """
    one = parents_found(found, parent, place).join(about.select(parent, *fields), parent)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")
    return one.select(place, pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def distinct_lists(rows: DataFrame, key: str, lists: dict[str, tuple[str, Column]]) -> DataFrame:
    """(``key``, lists): for each name the sorted distinct values of a column over the rows that meet its condition.

    Values are made distinct as rows of (key, list, value), so one list's repeats are gone before a cell holds it; a key
    none of whose rows meets a condition has empty lists.
    """
    held = F.explode(F.array(*(F.when(when, F.struct(F.lit(n).alias("list"), F.col(c).cast("string").alias("value"))) for n, (c, when) in lists.items())))
    every = rows.select(key, held.alias("p")).select(key, "p.list", "p.value").distinct()
    of = lambda n: F.array_sort(F.collect_list(F.when(F.col("list") == n, F.col("value"))))
    return every.groupBy(key).agg(*(of(n).alias(n) for n in lists))
