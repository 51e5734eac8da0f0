"""Answers with citations: extractive synthesis, marker rewriting, verification, history windows, context blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import markers, provider_spec, sentences, word_set

LEAST_CHARS, SENTENCES_EACH, TOP_CHUNKS, WEAK = 30, 2, 5, 0.05


def extract(text: Column) -> Column:
    """The first two sentences of more than 30 characters, joined by a blank; empty if there are none."""
    marked = F.replace(F.replace(F.replace(F.btrim(text), F.lit("? "), F.lit("?|")), F.lit(". "), F.lit(".|")), F.lit("! "), F.lit("!|"))
    pieces = F.filter(F.transform(F.split(marked, r"\|"), lambda s: F.btrim(s)), lambda s: F.length(s) > LEAST_CHARS)
    return F.array_join(F.slice(pieces, 1, SENTENCES_EACH), " ")


def extractive_answer(chunks: DataFrame, query: str, place: str, chunk: str, text: str) -> DataFrame:
    """(query, response, cited): "[i] ..." paragraphs of the first five chunks by place that have a sentence."""
    top = chunks.where(F.col(place) <= TOP_CHUNKS).withColumn("said", extract(F.col(text))).where("said <> ''")
    listed = F.sort_array(F.collect_list(F.struct(F.col(place).alias("i"), F.col(chunk).alias("chunk"), F.concat(F.lit("["), F.col(place).cast("string"), F.lit("] "), F.col("said")).alias("line"))))
    return top.groupBy(query).agg(listed.alias("l")).select(query, F.array_join("l.line", "\n\n").alias("response"), F.col("l.chunk").alias("cited"))


def renumbered(text: Column, old_to_new: Column) -> Column:
    """The text with each ``[N]`` replaced by its number in the map; markers without an entry stay."""
    parts = F.split(text, r"(?=\[\d+\])")

    def one(part: Column) -> Column:
        n = F.regexp_extract(part, r"^\[(\d+)\]", 1)
        new = F.try_element_at(old_to_new, n.try_cast("int"))
        return F.when((n != "") & new.isNotNull(), F.concat(F.lit("["), new.cast("string"), F.lit("]"), F.substring(part, F.length(n) + 3, F.length(part)))).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def citation_order(cited: DataFrame, answer: str, chunk: str, position: str) -> DataFrame:
    """(answer, chunk, number): first occurrences numbered from 1 in the order of ``position``."""
    first = cited.groupBy(answer, chunk).agg(F.min(position).alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(answer).orderBy("at", chunk))).drop("at")


def verify(answers: DataFrame, chunks: DataFrame, answer: str, response: str, number: str, text: str, threshold: float = WEAK) -> DataFrame:
    """(answer, place, citation, severity): markers outside the answer's chunks, or with too little overlap.

    ``answers`` has one row for each answer with its response, ``chunks`` (answer, number, text).  A claim or chunk
    without words of four letters is not judged.
    """
    count = chunks.groupBy(answer).agg(F.count("*").alias("n_chunks"))
    split = answers.select(answer, F.posexplode(sentences(F.col(response))).alias("place", "sentence"))
    marked = split.select(answer, "place", "sentence", F.explode(F.array_distinct(markers(F.col("sentence")))).alias("citation"))
    claim = word_set(F.replace("sentence", F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("]")), F.lit("")))
    marked = marked.select(answer, "place", "citation", claim.alias("claim")).join(count, answer, "left")
    known = chunks.select(answer, F.col(number).cast("long").alias("citation"), word_set(F.col(text)).alias("words"))
    joined = marked.join(known, [answer, "citation"], "left")
    invalid = (F.col("citation") < 1) | (F.col("citation") > F.coalesce("n_chunks", F.lit(0)))
    share = F.size(F.array_intersect("claim", "words")) / F.size("claim")
    weak = (F.size("claim") > 0) & (F.size("words") > 0) & (share < threshold)
    return joined.withColumn("severity", F.when(invalid, "invalid").when(weak, "weak")).where("severity is not null").select(answer, "place", "citation", "severity")


def recent(turns: DataFrame, conv: str, turn: str, text: str, n: int = 6) -> DataFrame:
    """Each turn with the texts of up to n turns before it, oldest first."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(text).over(before))


def context_block(chunks: DataFrame, query: str, number: str, source: Column, text: str) -> DataFrame:
    """(query, context): "[i] Source: ..." lines with the passages, in order."""
    line = F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] Source: "), source, F.lit("\n"), F.col(text))
    listed = F.sort_array(F.collect_list(F.struct(F.col(number).alias("i"), line.alias("line"))))
    return chunks.groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("context"))


# Intents of a question.
INTENTS = ("about_specific_drug", "find_drugs_by_effect", "general")


def links(pmid: Column, pmcid: Column) -> Column:
    """struct<pubmed_url, pmc_url> of a record's ids."""
    return F.struct(
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("pubmed_url"),
        F.when(F.coalesce(pmcid, F.lit("")) != "", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmcid, F.lit("/"))).alias("pmc_url"),
    )


def assembled(answers: DataFrame, chunks: DataFrame, answer: str, response: str, cited: str, number: str, chunk: str) -> DataFrame:
    """(answer, response, citations): citations numbered from 1 in the order in which ``cited`` (chunk ids) first names them.

    ``chunks`` is (answer, number, chunk), number being the N of ``[N]`` in the text.  Markers are rewritten to the new
    numbers; markers of chunks that are not cited, or of none, stay.  Nothing cited means all chunks, as numbered.
    citations is array<struct<number, chunk>>.
    """
    named = answers.where(F.size(F.coalesce(cited, F.array())) > 0).select(answer, F.posexplode(cited).alias("at", "chunk_id"))
    known = chunks.select(answer, F.col(chunk).alias("chunk_id"), F.col(number).cast("int").alias("old"))
    explicit = citation_order(named.join(known.select(answer, "chunk_id").distinct(), [answer, "chunk_id"], "left_semi"), answer, "chunk_id", "at")
    none = answers.where(F.size(F.coalesce(cited, F.array())) == 0).select(answer)
    every = explicit.unionByName(known.join(none, answer, "left_semi").select(answer, "chunk_id", F.col("old").alias("number")))
    numbered = every.groupBy(answer).agg(F.sort_array(F.collect_list(F.struct("number", "chunk_id"))).alias("citations"))
    moves = every.join(known, [answer, "chunk_id"]).groupBy(answer).agg(F.map_from_entries(F.collect_list(F.struct("old", F.col("number").cast("int")))).alias("moves"))
    joined = answers.join(numbered, answer, "left").join(moves, answer, "left")
    moved = F.when(F.col("moves").isNull(), F.col(response)).otherwise(renumbered(F.col(response), F.col("moves")))
    return joined.select(answer, moved.alias("response"), F.coalesce("citations", F.array().cast("array<struct<number:int,chunk_id:bigint>>")).alias("citations"))


def intent(raw: Column) -> Column:
    """struct<intent, drug_names, indication_terms> of a model's text; whatever cannot be read is the general intent.

    The JSON object may stand in other text; an unknown intent is general, names are trimmed and lower-cased, terms trimmed,
    and parts that are no strings are left out.
    """
    whole = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    given = F.get_json_object(whole, "$.intent")
    strings = lambda path: F.filter(F.coalesce(F.from_json(F.get_json_object(whole, path), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    trimmed = lambda path: F.transform(strings(path), lambda x: F.btrim(x))
    known = F.coalesce(given.isin(*INTENTS), F.lit(False))
    return F.struct(
        F.when(known, given).otherwise("general").alias("intent"),
        F.transform(trimmed("$.drug_names"), lambda x: F.lower(x)).alias("drug_names"),
        trimmed("$.indication_terms").alias("indication_terms"),
    )


def asked_model(rows: DataFrame, text: str, build: Callable[[], Callable[[str], str]], out: str = "raw") -> DataFrame:
    """``rows`` with the answer of an injected model to each text; a call that fails gives null, so that a default follows."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()

        def safe(t: str) -> str | None:
            try:
                return model(t)
            except Exception:  # noqa: BLE001 - any failure of a remote model means the default
                return None

        for frame in frames:
            yield frame.assign(**{out: [safe(t) for t in frame[text]]})

    return rows.mapInPandas(run, schema)


def synthesised(rows: DataFrame, spec: Column, prompt: str, providers: dict[str, Callable[[], Callable[[str], str]]], out: str = "response") -> DataFrame:
    """``rows`` with the answer of the provider that each row's spec names; an unknown provider gives null.

    ``providers`` are builders of injected models by name; each sees only its own rows.
    """
    marked, every = rows.withColumn("_provider", provider_spec(spec)["provider"]), None
    for name, build in providers.items():
        part = asked_model(marked.where(F.col("_provider") == name).drop("_provider"), prompt, build, out)
        every = part if every is None else every.unionByName(part)
    rest = marked.where(~F.col("_provider").isin(*providers)).drop("_provider").withColumn(out, F.lit(None).cast("string"))
    return rest if every is None else every.unionByName(rest)
