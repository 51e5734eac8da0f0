"""Drug labels and the look-up of drugs: rows of labels, what is missing in them, cards, sections of articles, the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import prose
from siltstone.operators.fuzzy import ACCEPT, similarity, trigrams
from siltstone.operators.upserts import insert_ignore
from siltstone.sources.store import shared_folder
from siltstone.sources.tables import parsed, text_tasks

# Heading parts of a compound page and the field they fill, the more specific ones first.
HEADING_RULES = {
    "indications": ["drug indication", "therapeutic use", "indication and usage"],
    "mechanism": ["mechanism of action", "moa"],
    "pharmacology": ["pharmacology", "pharmacodynamics", "pharmacokinetics", "absorption", "metabolism"],
    "dosage": ["dosage and administration", "dosage", "fda approved products"],
    "contraindications": ["contraindication"],
    "warnings": ["drug warning", "boxed warning", "drug-drug interaction", "drug interactions"],
}
# Fields of a card with their labels, in order.
CARD_FIELDS = {"indications": "Indications", "mechanism": "Mechanism", "pharmacology": "Pharmacology", "dosage": "Dosing", "contraindications": "Contraindications", "warnings": "Warnings"}
CARD_CHARS, BRANDS, CARDS = 1500, 5, 3


def newest_labels(existing: DataFrame, labels: DataFrame, name: str, updated: str) -> DataFrame:
    """``existing`` and, for each name it lacks (case ignored), the newest label; older ones and known names are skipped."""
    key = lambda df: df.withColumn("_key", F.lower(name))
    fresh = key(labels.where(F.col(name).isNotNull())).withColumn("_order", F.struct(F.coalesce(F.col(updated).isNull(), F.lit(True)).alias("a"), F.expr(f"-coalesce(cast(`{updated}` as long), 0)").alias("b")))
    return insert_ignore(key(existing).withColumn("_order", F.lit(None).cast(fresh.schema["_order"].dataType)), fresh, ["_key"], "_order").drop("_key", "_order")


def wanting(rows: DataFrame, key: str, real: Column, fields: list[str], name: str, patterns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of real labels that lack a field: those without the first field before those without the next, then by key.

    ``patterns`` keep names that contain one of them, case ignored.
    """
    lacks = [F.coalesce(F.col(f) == "", F.lit(True)) for f in fields]
    some = rows.where(real & F.greatest(*(x.cast("int") for x in lacks)).cast("boolean"))
    if patterns:
        some = some.where(F.exists(F.array(*(F.lit(f"%{p}%") for p in patterns)), lambda p: F.ilike(F.col(name), p)))
    some = some.orderBy(*(x.desc() for x in lacks), key)
    return some.limit(limit) if limit else some


def outcomes(rows: DataFrame, outcome: Column) -> DataFrame:
    """(outcome, n): the counters of a run."""
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def card_text(name: Column, source: Column, brands: Column, fields: dict[str, Column], most: int = CARD_CHARS) -> Column:
    """The card of a drug as text: a header, up to five brands, and the fields that hold something, cut at a sentence."""
    header = F.concat(F.lit("DRUG REFERENCE — "), F.upper(name), F.lit(" ("), F.upper(source), F.lit(")"))
    listed = F.when(F.size(F.coalesce(brands, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Brand names: "), F.array_join(F.slice(brands, 1, BRANDS), ", ")))
    lines = [F.when(F.coalesce(F.trim(fields[f]), F.lit("")) != "", F.concat(F.lit(f"{label}: "), prose(fields[f], most))) for f, label in CARD_FIELDS.items() if f in fields]
    return F.concat_ws("\n", header, listed, *lines)


def bucket_of(heading: Column) -> Column:
    """The field that a heading fills; null for others."""
    low, out = F.lower(heading), F.lit(None).cast("string")
    for bucket, parts in reversed(HEADING_RULES.items()):
        out = F.when(F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(low, p)), bucket).otherwise(out)
    return out


def page_sections(pages: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(``id_col``, bucket, texts): texts over 15 characters under recognised headings of a nested JSON page, in the page's order.

    A section is {TOCHeading, Information: [{Value: {StringWithMarkup: [{String}]}}], Section: [...]}.  Levels are walked until
    no page has one left, which a look at each level decides.  Pages are dealt by their bytes, as the files they are read from may be
    few, and what a level leaves to the next one is checkpointed, so each section is parsed once.
    """
    info = "Information:array<struct<Value:struct<StringWithMarkup:array<struct<String:string>>>>>"
    kind = f"struct<TOCHeading:string,{info},Section:array<string>>"
    shared_folder(pages.sparkSession)
    pages = pages.select(id_col, F.col(raw).alias("j"))
    left, found = pages.repartition(text_tasks(pages), id_col).select(id_col, F.array().cast("array<int>").alias("at"), "j"), None
    while True:
        texts = F.filter(F.flatten(F.col("s.Information.Value.StringWithMarkup"))["String"], lambda x: F.length(x) > 15)
        level = parsed(left, "s", F.from_json("j", kind)).select(id_col, "at", bucket_of(F.col("s.TOCHeading")).alias("bucket"), texts.alias("t"), F.col("s.Section").alias("next")).checkpoint()
        here = level.where("bucket is not null and size(t) > 0").select(id_col, "at", "bucket", "t")
        found = here if found is None else found.unionByName(here)
        if level.where(F.size("next") > 0).isEmpty():
            break
        left = level.select(id_col, "at", F.posexplode("next").alias("i", "j")).select(id_col, F.concat("at", F.array("i")).alias("at"), "j")
    listed = F.sort_array(F.collect_list(F.struct("at", "t")))
    return found.groupBy(id_col, "bucket").agg(F.flatten(F.transform(listed, lambda x: x["t"])).alias("texts"))


def article_sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(``id_col``, heading, content) of plain article texts; what stands before the first heading is the summary.

    A heading is a line of under 60 characters and at most six words, not ending in . : ? or !, not beginning in lower case,
    with a letter; marks of equal signs around it are taken off.  Of equal headings the last one with content counts.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.btrim("line")).where("line <> ''")
    first = F.substring("line", 1, 1)
    words = F.size(F.split("line", r"\s+"))
    heading = (F.length("line") < 60) & ~F.col("line").rlike(r"[.:?!]$") & ~((F.lower(first) == first) & (F.upper(first) != first)) & (words <= 6) & F.col("line").rlike(r"\p{L}")
    before = Window.partitionBy(id_col).orderBy("at")
    marked = lines.withColumn("is_heading", heading).withColumn("section", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(before))
    name = F.max(F.when(F.col("is_heading"), F.col("line")))
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("at", "line")))), lambda x: x["line"])
    parts = marked.groupBy(id_col, "section").agg(name.alias("name"), F.array_join(body, " ").alias("content")).where("content <> ''")
    clean = F.lower(F.btrim(F.regexp_replace(F.coalesce("name", F.lit("summary")), r"^={2,}\s*(.*?)\s*={2,}$", "$1")))
    return parts.withColumn("heading", clean).groupBy(id_col, "heading").agg(F.max_by("content", "section").alias("content"))


def section_named(sections: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(``id_col``, content): the section of the first of ``names`` that a heading equals, else all whose heading contains one."""
    wanted = F.array(*(F.lit(n) for n in names))
    exact = F.array_position(wanted, F.col("heading"))
    inside = F.filter(F.transform(wanted, lambda n, i: F.when(F.contains(F.col("heading"), n), i + 1)), lambda i: i.isNotNull())
    rows = sections.select(id_col, "heading", "content", F.when(exact > 0, exact).alias("exact"), F.array_min(inside).alias("inside")).where("exact is not null or inside is not null")
    best = F.min(F.when(F.col("exact").isNotNull(), F.struct("exact", "content")))["content"]
    parts = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("inside", "heading", "content"))), lambda x: x["content"]))
    return rows.groupBy(id_col).agg(F.coalesce(best, F.array_join(parts, "\n\n")).alias("content"))


def forward(queries: DataFrame, rows: DataFrame, query: str, candidates: str, name: str, brands: str) -> DataFrame:
    """(``query``, candidate, ``name``): for each candidate the row of that name or brand, else of the most similar name.

    Exact hits are an equality join; the others meet names on a shared trigram, and ``ACCEPT`` decides.
    """
    asked = queries.select(query, F.explode(F.array_distinct(candidates)).alias("candidate"))
    wanted = asked.select("candidate").distinct()
    keys = rows.select(name, F.explode(F.array_union(F.array(F.lower(name)), F.transform(F.coalesce(brands, F.array().cast("array<string>")), lambda b: F.lower(b)))).alias("key"))
    exact = wanted.join(keys, F.lower("candidate") == F.col("key")).groupBy("candidate").agg(F.min(name).alias("hit"))
    rest = wanted.join(exact, "candidate", "left_anti").withColumn("g", trigrams(F.col("candidate")))
    named = rows.select(name).distinct().withColumn("h", trigrams(F.col(name)))
    met = rest.withColumn("x", F.explode("g")).join(named.withColumn("x", F.explode("h")), "x").select("candidate", "g", name, "h").distinct()
    near = met.withColumn("s", similarity(F.col("g"), F.col("h"))).where(F.col("s") >= ACCEPT)
    near = near.groupBy("candidate").agg(F.min_by(name, F.struct((-F.round("s", 9)).alias("s"), F.col(name).alias("n"))).alias("hit"))
    return asked.join(exact.unionByName(near), "candidate").select(query, "candidate", F.col("hit").alias(name))


def chain(queries: DataFrame, query: str, intent: str, found: DataFrame, external: DataFrame, reverse: DataFrame, name: str, order: str, n: int = CARDS) -> DataFrame:
    """(``query``, ``name``, source, place): the cards of each question, at most ``n``.

    Questions about an effect skip the look-up by name; a name that the table lacks may come from ``external``; a question
    without a card, and not about a certain drug, takes those of the look-up by indication.
    """
    part = lambda df, k: df.select(query, name, F.col(order).alias("_order"), F.lit(k).alias("source"))
    forward_ok = queries.where(F.coalesce(intent, F.lit("general")) != "find_drugs_by_effect").select(query)
    named = part(found, "table").unionByName(part(external.join(found.select(query, name), [query, name], "left_anti"), "external")).join(forward_ok, query, "left_semi")
    open_ = queries.where(F.coalesce(intent, F.lit("general")) != "about_specific_drug").select(query).join(named.select(query), query, "left_anti")
    every = named.unionByName(part(reverse, "indication").join(open_, query, "left_semi"))
    first = every.groupBy(query, name).agg(F.min(F.struct("_order", "source")).alias("b")).select(query, name, "b.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("_order", name))).where(F.col("place") <= n).select(query, name, "source", "place")
