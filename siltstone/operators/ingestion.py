"""Ingestion: what a batch did to each queued id, dates, chunks of abstracts, tagged entities, sparse vectors, point look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_CHARS, LEAST_ENTITY, LEAST_SCORE = 2000, 3, 0.5
MOST_CHUNKS, MOST_LABELS, MOST_CHARS = 20, 200, 20_000
# Labels of the tagger and the entity types they stand for; null: too general, dropped, as are other labels.
ENTITY_TYPES = {
    "DISEASE_DISORDER": "DISEASE", "SIGN_SYMPTOM": "SYMPTOM", "MEDICATION": "CHEMICAL", "BIOLOGICAL_STRUCTURE": "ANATOMY", "DIAGNOSTIC_PROCEDURE": "PROCEDURE", "THERAPEUTIC_PROCEDURE": "PROCEDURE",
    "DETAILED_DESCRIPTION": None, "BIOLOGICAL_ATTRIBUTE": None, "CLINICAL_EVENT": None, "LAB_VALUE": None, "FAMILY_HISTORY": None, "HISTORY": None, "AGE": None, "SEX": None, "DURATION": None, "FREQUENCY": None,
    "DATE": None, "TIME": None, "AREA": None, "VOLUME": None, "MASS": None, "DISTANCE": None, "DOSAGE": None, "OUTCOME": None, "ADMINISTRATION": None, "PERSONAL_BACKGROUND": None, "ACTIVITY": None, "SUBJECT": None,
    "SEVERITY": None, "COREFERENCE": None,
    "DISEASE": "DISEASE", "CHEMICAL": "CHEMICAL", "GENE": "GENE_OR_GENE_PRODUCT", "PROTEIN": "GENE_OR_GENE_PRODUCT", "CELL": "CELL_TYPE", "ORGANISM": "ORGANISM",
}
SPAN = "struct<label:string,start:int,end:int,score:double>"


def message(c: Column) -> Column:
    """An error message as it is stored: at most 2000 characters."""
    return F.left(c, F.lit(MESSAGE_CHARS))


def batch_outcomes(requested: DataFrame, returned: DataFrame, skipped: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """(key, status, error_message) of every requested id: indexed, error, or skipped for entries that are no articles.

    An id that neither came back nor was skipped is an error, to be tried again.  ``failed`` (key, error) are returned ids
    whose own write failed: the error is theirs alone.
    """
    marked = requested.select(key).distinct().join(returned.select(key, F.lit(True).alias("_got")).distinct(), key, "left").join(skipped.select(key, F.lit(True).alias("_skip")).distinct(), key, "left")
    marked = marked.join(failed.groupBy(key).agg(F.min("error").alias("_error")), key, "left") if failed is not None else marked.withColumn("_error", F.lit(None).cast("string"))
    got, skip = F.coalesce("_got", F.lit(False)), F.coalesce("_skip", F.lit(False))
    status = F.when(got & F.col("_error").isNull(), "indexed").when(skip & ~got, "skipped").otherwise("error")
    text = F.when(got, F.col("_error")).when(skip, "not a journal article (book/monograph)").otherwise("not returned by EFetch")
    return marked.select(key, status.alias("status"), message(text).alias("error_message"))


def advanced(log: DataFrame, outcomes: DataFrame, key: str, now: Column) -> DataFrame:
    """The log (key, status, error_message, retry_count, updated_at) after a batch: a state machine's step.

    queued and fetching rows take their outcome; an error counts a retry; indexed and skipped rows are final.
    """
    joined = log.join(outcomes.select(key, F.col("status").alias("_s"), F.col("error_message").alias("_m")), key, "left")
    moves = F.col("_s").isNotNull() & ~F.coalesce(F.col("status").isin("indexed", "skipped"), F.lit(False))
    return joined.select(
        key,
        F.when(moves, F.col("_s")).otherwise(F.col("status")).alias("status"),
        F.when(moves, F.col("_m")).otherwise(F.col("error_message")).alias("error_message"),
        (F.coalesce("retry_count", F.lit(0)) + F.when(moves & (F.col("_s") == "error"), 1).otherwise(0)).alias("retry_count"),
        F.when(moves, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def safe_rows(rows: DataFrame, key: str, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors (key, error)): ``values`` are tolerant expressions, and a row in which one is null fails alone."""
    tried = rows.select(key, *(v.alias(c) for c, v in values.items()))
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in values)))
    marked = tried.withColumn("_bad", bad)
    return marked.where(F.size("_bad") == 0).drop("_bad"), marked.where(F.size("_bad") > 0).select(key, F.concat(F.lit("cannot read "), F.array_join("_bad", ", ")).alias("error"))


def iso_date(c: Column, compat: bool = False) -> Column:
    """A date of year-month-day, the month a number or its English abbreviation; with ``compat`` numbers only.  Else null."""
    numeric = F.regexp_replace(c, r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3")
    plain = F.when(c.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(numeric, F.lit("y-M-d")).cast("date"))
    return plain if compat else F.coalesce(plain, F.when(c.rlike(r"^\d{4}-[A-Z][a-z]{2}-\d{1,2}$"), F.try_to_timestamp(c, F.lit("y-MMM-d")).cast("date")))


def abstract_chunks(papers: DataFrame, key: str, abstract: str, title: str, existing: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """(``key``, chunk_index, chunk_text, start_char, end_char, token_count): one chunk a paper, abstract or else title.

    An empty abstract counts as missing; with ``compat`` only a null one does, and token_count may be 0.  Papers that
    ``existing`` has a chunk 0 for are left out.
    """
    first = F.col(abstract) if compat else F.nullif(F.col(abstract), F.lit(""))
    rows = papers.select(key, F.coalesce(first, F.col(title), F.lit("")).alias("chunk_text"))
    if existing is not None:
        rows = rows.join(existing.where("chunk_index = 0").select(key), key, "left_anti")
    tokens = F.floor(F.length("chunk_text") / 4)
    return rows.select(key, F.lit(0).alias("chunk_index"), "chunk_text", F.lit(0).alias("start_char"), F.length("chunk_text").alias("end_char"), (tokens if compat else F.greatest(F.lit(1), tokens)).cast("int").alias("token_count"))


def entity_type(label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ENTITY_TYPES.items() for x in kv))
    return F.try_element_at(table, F.upper(label))


def entities(chunks: DataFrame, chunk: str, text: str, spans: str, done: DataFrame | None = None) -> DataFrame:
    """(``chunk``, entity_text, entity_type, start_char, end_char) of tagged spans (label, start, end, score).

    The text is taken by its offsets.  Kept are known labels, three characters or more with a letter and no word-piece mark,
    and scores of 0.5 or more (a missing score passes); of equal (text, type, start) one stays.  Chunks that ``done`` has
    entities of are left out.
    """
    rows = chunks.join(done.select(chunk).distinct(), chunk, "left_anti") if done is not None else chunks
    rows = rows.select(chunk, text, F.explode(spans).alias("s"))
    word = F.btrim(F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    rows = rows.select(chunk, word.alias("entity_text"), entity_type(F.col("s.label")).alias("entity_type"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.coalesce("s.score", F.lit(1.0)).alias("score"))
    good = F.col("entity_type").isNotNull() & (F.col("end_char") > F.col("start_char")) & (F.length("entity_text") >= LEAST_ENTITY) & ~F.startswith("entity_text", F.lit("##"))
    rows = rows.where(good & F.col("entity_text").rlike(r"\p{L}") & (F.col("score") >= LEAST_SCORE))
    first = F.min(F.struct("end_char", "entity_text")).alias("f")
    return rows.groupBy(chunk, F.lower("entity_text").alias("_k"), "entity_type", "start_char").agg(first).select(chunk, F.col("f.entity_text").alias("entity_text"), "entity_type", "start_char", F.col("f.end_char").alias("end_char"))


def tagged(chunks: DataFrame, chunk: str, text: str, build: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """``chunks`` (chunk, text) with the spans of an injected tagger, built once in each worker."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = build()
        for frame in frames:
            yield frame.assign(spans=tag([t or "" for t in frame[text]]))

    return chunks.select(chunk, text).mapInPandas(run, f"{chunk} {kinds[chunk]}, {text} string, spans array<{SPAN}>")


def ordered_texts(papers: DataFrame, chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``papers`` that have chunks, with ``texts`` in order: the input of a document encoder."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return papers.join(chunks.groupBy(key).agg(listed.alias("texts")), key)


def replaced_vectors(docs: DataFrame, fresh: DataFrame, key: str, vector: str) -> DataFrame:
    """``docs`` with the vector of ``fresh`` where it has one: a partial update of one field."""
    joined = docs.join(fresh.select(key, F.col(vector).alias("_new")), key, "left")
    return joined.withColumn(vector, F.coalesce("_new", vector)).drop("_new").select(docs.columns)


def missing_vectors(docs: DataFrame, vector: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` in which rows without a vector get one; rows that have one are not encoded again."""
    return docs.where(F.col(vector).isNotNull()).unionByName(encode(docs.where(F.col(vector).isNull())).select(docs.columns))


def ensured(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table ``name``, created empty if there is none; columns of ``schema`` that it lacks read as null."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    have, wanted = spark.table(name), spark.createDataFrame([], schema)
    return have.select(*have.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema.fields if f.name not in have.columns))


def point(papers: DataFrame, journals: DataFrame, key: str, wanted: str, journal: str) -> DataFrame:
    """The paper of that key with its journal's columns; no row is a 404."""
    return papers.where(F.col(key) == wanted).join(F.broadcast(journals), journal, "left")


def checked_request(requests: DataFrame, query: str, top_k: str, strategies: tuple[str, ...] = ("bm25", "hybrid", "hipporag", "full"), roles: str | None = None) -> DataFrame:
    """``requests`` with ``problem``: why a request is refused, null if it is not.

    ``roles`` is an array of the roles of earlier messages, each of which must be user or assistant.
    """
    size = F.length(F.coalesce(F.col(query), F.lit("")))
    problem = F.when(~size.between(3, 2000), "query length").when(~F.coalesce(F.col(top_k).between(1, 50), F.lit(False)), "top_k").when(~F.coalesce(F.col("strategy").isin(*strategies), F.lit(False)), "strategy")
    if roles:
        problem = problem.when(F.exists(roles, lambda r: ~F.coalesce(r.isin("user", "assistant"), F.lit(False))), "role")
    return requests.withColumn("problem", problem)


def checked_graph_request(requests: DataFrame, query: str, answer: str, chunks: str, labels: str) -> DataFrame:
    """``requests`` with ``problem``: a graph is asked of a question, an answer, at most 20 chunks and at most 200 labels.

    Chunks and answers have at most 20,000 characters; missing lists are empty.
    """
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    many = lambda c, n: F.coalesce(F.size(c) > n, F.lit(False))
    long = F.coalesce(F.exists(chunks, lambda x: F.length(x) > MOST_CHARS), F.lit(False))
    problem = F.when(~size(query).between(3, 2000), "query length").when(~size(answer).between(1, MOST_CHARS), "answer length")
    problem = problem.when(many(chunks, MOST_CHUNKS), "chunks").when(long, "chunk length").when(many(labels, MOST_LABELS), "labels")
    return requests.withColumn("problem", problem)
