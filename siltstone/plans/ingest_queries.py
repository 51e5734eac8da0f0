"""Registered queries of ingestion: readers, record layers, batch outcomes, entities, labels, keys and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, druglabels, ingestion, keys, upserts, vectors
from siltstone.plans.registry import joined, longs, md5, query, r6
from siltstone.sources import compounds, connectors, tables
from siltstone.streaming import state

# Readers


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS id FROM events")
def paged_scan(t):
    """A Python data source of as many rows as there are events, 700 a page."""
    n = t("events").count()
    source = connectors.paged_source("siltstone_pages", "id long", lambda: n, lambda at, size: [(k,) for k in range(at, min(at + size, n))], 700)
    t.spark.dataSource.register(source)
    return t.spark.read.format("siltstone_pages").load()


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) || ':' || unnest(range(0, least(n, 300))) AS id FROM d")
def id_discovery(t):
    """Ids are day and number; a day's list is cut at the cap of 300, longer ranges are halved."""
    import datetime as dt

    # A row a day.
    days = {r["day"]: r["n"] for r in t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}

    def fetch(a: dt.date, b: dt.date, at: int, size: int) -> list[str]:
        every = [f"{d}:{k}" for d in sorted(days) if a <= d <= b for k in range(days[d])]
        return every[at : at + size]

    return connectors.discover(t.spark, lambda a, b: sum(n for d, n in days.items() if a <= d <= b), fetch, min(days), max(days), 300, 100)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '<r>' || c_custkey || '</r>' END AS record, CASE WHEN c_custkey % 7 = 0 THEN 'not returned' END AS error FROM customer")
def batch_fetch(t):
    return connectors.fetch_batches(t("customer"), "c_custkey", lambda ids: {i: f"<r>{i}</r>" for i in ids if i % 7})


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS open FROM documents")
def open_access_gate(t):
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("<article>")).otherwise("<error>"), "text")
    return t("documents").withColumn("text", F.replace("text", F.lit("<article"), F.lit(""))).select("doc_id", connectors.open_access(body).cast("int").alias("open"))


@query("SELECT p_partkey, p_name, place FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice * 1000000 + p_partkey DESC) AS place FROM part WHERE p_name IN ('red plate', 'blue plate')) WHERE place <= 10")
def label_siblings(t):
    labels = t("part").withColumn("effective", F.col("p_retailprice") * 1000000 + F.col("p_partkey"))
    names = t.spark.createDataFrame([("RED PLATE",), ("Blue Plate",)], "p_name string")
    return connectors.siblings(labels, names, "p_name", "effective").select("p_partkey", "p_name", F.col("place").cast("long"))


@query("SELECT doc_id, lang FROM documents WHERE length(text) >= 200 AND (contains(lower(source), lang) OR contains(lower(left(text, 500)), lang))")
def article_gate(t):
    return connectors.relevant_articles(t("documents"), "lang", "source", "text").select("doc_id", "lang")


_NAMES = "SELECT unnest(['thanedble', 'ofonrereer', 'forrendsten', 'nosuchword']) AS name"


@query(f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), h AS (SELECT name, doc_id, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS place FROM ({_NAMES}) JOIN d ON list_contains(w, name) WHERE list_has_any(w, ['the', 'and', 'que']))
SELECT name, doc_id FROM h WHERE place <= 200""")
def literature_mentions(t):
    names = t.spark.createDataFrame([(x,) for x in ("thanedble", "ofonrereer", "forrendsten", "nosuchword")], "name string")
    return connectors.mentions(t("documents"), "doc_id", "text", names, "name", ["the", "and", "que"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stage_pending(t):
    return tables.pending(t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


# Compounds and seeds: suppliers are targets, parts molecules, lines activities


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 0 AND s_name LIKE '%1'")
def target_by_gene(t):
    rows = t("supplier").withColumn("organism", F.when(F.col("s_nationkey") % 2 == 0, "Homo sapiens")).withColumn("target_type", F.when(F.col("s_acctbal") > 0, "SINGLE PROTEIN").otherwise("COMPLEX"))
    return compounds.by_gene(rows, F.endswith("s_name", F.lit("1")), "organism").select("s_suppkey")


@query("SELECT DISTINCT l_suppkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size >= 49 AND s_nationkey % 2 = 0")
def clinical_targets(t):
    found = compounds.clinical_targets(t("lineitem"), t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_suppkey", "l_partkey", "p_size", 49)
    human = t("supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return found.join(human, "l_suppkey", "left_semi").select(F.col("l_suppkey").alias("target"))


@query("SELECT DISTINCT l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R'")
def mechanism_targets(t):
    return compounds.clinical_targets(compounds.mechanisms(t("lineitem"), "l_returnflag", F.lit("R")), t("part"), "l_suppkey", "l_partkey", "p_size").select(F.col("l_suppkey").alias("target"))


@query("SELECT l_suppkey AS target, l_partkey AS compound, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS value FROM lineitem GROUP BY ALL")
def target_links(t):
    first = compounds.first_activities(t("lineitem"), "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"])
    return first.select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("compound"), F.col("l_extendedprice").alias("value"))


@query("""SELECT p_partkey, 'C' || p_partkey AS chembl_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'C' || p_partkey END AS name, CAST(p_size AS BIGINT) AS max_phase, p_type AS formula, p_retailprice AS weight, p_brand || ',' || p_name AS synonyms FROM part""")
def compound_record(t):
    synonyms = F.array(F.struct(F.col("p_brand").alias("molecule_synonym")), F.struct(F.col("p_name").alias("molecule_synonym")))
    inner = F.struct(F.col("p_type").alias("full_molformula"), F.col("p_retailprice").alias("full_mwt"))
    raw = F.to_json(F.struct(F.concat(F.lit("C"), "p_partkey").alias("molecule_chembl_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("pref_name"), F.col("p_size").alias("max_phase"), inner.alias("molecule_properties"), synonyms.alias("molecule_synonyms")))
    read = t("part").select("p_partkey", compounds.compound_record(raw).alias("r"))
    return read.select("p_partkey", "r.chembl_id", "r.name", F.col("r.max_phase").cast("long").alias("max_phase"), "r.formula", "r.weight", joined(F.col("r.synonyms")).alias("synonyms"))


@query("SELECT p_partkey, array_to_string([p_name, p_brand, p_type], ',') AS terms FROM part")
def compound_terms(t):
    long = F.repeat(F.lit("x"), F.lit(61))
    return t("part").select("p_partkey", joined(T.search_terms(F.col("p_name"), F.array("p_brand", F.upper("p_name"), long, "p_type", "p_brand"))).alias("terms"))


@query("WITH s AS (SELECT p_type AS name, min(p_size) AS priority FROM part GROUP BY 1) SELECT name, CAST(priority AS BIGINT) AS priority FROM s WHERE priority <= 1")
def seed_topics(t):
    seed = t("part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_size").cast("long").alias("priority"))
    return compounds.topics(seed, 1)


@query("SELECT p_name AS gene FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') GROUP BY 1 HAVING bool_or(p_brand = 'Brand#11')")
def seed_targets(t):
    seed = t("part").groupBy(F.col("p_name").alias("gene")).agg(F.collect_set("p_brand").alias("biology"))
    return compounds.all_genes(compounds.targets_of(seed, "Brand#11"))


# Batches and records


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'skipped' WHEN c_custkey % 5 = 0 OR c_custkey % 13 = 1 THEN 'error' ELSE 'indexed' END AS status,
CASE WHEN c_custkey % 11 = 0 THEN 'not a journal article (book/monograph)' WHEN c_custkey % 5 = 0 THEN 'not returned by EFetch' WHEN c_custkey % 13 = 1 THEN repeat('e', 2000) END AS error_message FROM customer""")
def batch_outcomes(t):
    c = t("customer").select("c_custkey")
    failed = c.where("c_custkey % 13 = 1").withColumn("error", F.repeat(F.lit("e"), F.lit(3000)))
    return ingestion.batch_outcomes(c, c.where("c_custkey % 11 <> 0 and c_custkey % 5 <> 0"), c.where("c_custkey % 11 = 0"), "c_custkey", failed)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'indexed' WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'indexed' END AS status, CAST(CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 3 ELSE 2 END AS BIGINT) AS retry_count, c_custkey % 3 <> 0 AS moved FROM customer""")
def queue_advance(t):
    """A third of the log is indexed already and stays; of the rest every fifth id does not come back."""
    start, now = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    c = t("customer").select("c_custkey")
    log = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "indexed").otherwise("fetching").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(2).alias("retry_count"), start.alias("updated_at"))
    out = ingestion.batch_outcomes(c, c.where("c_custkey % 5 <> 0"), c.where("false"), "c_custkey")
    return ingestion.advanced(log, out, "c_custkey", now).select("c_custkey", "status", F.col("retry_count").cast("long"), (F.col("updated_at") == now).alias("moved"))


@query("SELECT event_id, 'cannot read k, day' AS error FROM events WHERE event_id % 10 = 3")
def row_errors(t):
    """Every tenth record is broken; it fails alone."""
    raw = F.when(F.col("event_id") % 10 == 3, "{").otherwise(F.col("props"))
    good, bad = ingestion.safe_rows(t("events"), "event_id", {"k": F.get_json_object(raw, "$.k").try_cast("int"), "day": ingestion.iso_date(F.when(F.col("event_id") % 10 != 3, "2024-Jan-05"))})
    return bad.join(good.select("event_id"), "event_id", "left_anti")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) END AS intended, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END AS faithful FROM orders")
def iso_dates(t):
    k = F.col("o_orderkey") % 5
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MMM-dd")).when(k == 2, F.date_format("o_orderdate", "yyyy")).when(k == 3, "2021-02-30").otherwise("2021 Jan-Feb")
    return t("orders").select("o_orderkey", ingestion.iso_date(day).alias("intended"), ingestion.iso_date(day, compat=True).alias("faithful"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def compact_dates(t):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyyMM"))
    return t("orders").select("o_orderkey", T.compact_date(day).alias("day"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(source) ELSE length(text) END AS end_char, CAST(greatest(1, CASE WHEN doc_id % 3 = 0 THEN length(source) ELSE length(text) END // 4) AS BIGINT) AS token_count FROM documents WHERE doc_id % 4 <> 1")
def abstract_chunk(t):
    """Every third abstract is empty, so the title takes its place; a quarter of the papers has its chunk."""
    papers = t("documents").withColumn("abstract", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")))
    done = t("documents").where("doc_id % 4 = 1").select("doc_id", F.lit(0).alias("chunk_index"))
    return ingestion.abstract_chunks(papers, "doc_id", "abstract", "source", done).select("doc_id", *longs("end_char", "token_count"))


@query("""WITH s AS (SELECT doc_id, left(text, instr(text, ' ') - 1) AS w, doc_id % 4 AS k FROM documents WHERE instr(text, ' ') > 1)
SELECT doc_id, trim(w) AS entity_text, CASE k WHEN 1 THEN 'CHEMICAL' ELSE 'GENE_OR_GENE_PRODUCT' END AS entity_type, CAST(length(w) AS BIGINT) AS end_char FROM s
WHERE k <> 2 AND length(trim(w)) >= 3 AND NOT starts_with(trim(w), '##') AND regexp_matches(trim(w), '\\p{L}') AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def ner_entities(t):
    """The first word of each text is tagged, twice; a fifth of the scores is too low, a seventh of the chunks is done."""
    end = F.instr("text", " ") - 1
    label = F.element_at(F.array(*(F.lit(x) for x in ("Gene", "medication", "AGE", "Protein"))), (F.col("doc_id") % 4 + 1).cast("int"))
    score = F.when(F.col("doc_id") % 5 == 0, 0.4).when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise(0.9).cast("double")
    span = F.struct(label.alias("label"), F.lit(0).alias("start"), end.alias("end"), score.alias("score"))
    chunks = t("documents").where("instr(text, ' ') > 1").select("doc_id", "text", F.array(span, span).alias("spans"))
    found = ingestion.entities(chunks, "doc_id", "text", "spans", t("documents").where("doc_id % 7 = 0").select("doc_id"))
    return found.select("doc_id", "entity_text", "entity_type", F.col("end_char").cast("long"))


@query("SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS texts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def ordered_texts(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return ingestion.ordered_texts(t("orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", "part").select("o_orderkey", joined("texts").alias("texts"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1.5 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def vector_update(t):
    fresh = t("embeddings").where("vec_id % 2 = 0").select("vec_id", F.array(F.lit(1.5).cast("float")).alias("embedding"))
    return ingestion.replaced_vectors(t("embeddings"), fresh, "vec_id", "embedding").select("vec_id", r6(F.col("embedding")[0].cast("double")).alias("first"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS DOUBLE) ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def vector_fill(t):
    """A third of the vectors is missing and encoded from the label; the others are not touched."""
    rows = t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))).withColumn("label", F.col("label").cast("string"))
    filled = ingestion.missing_vectors(rows, "embedding", lambda df: vectors.encode(df, "label", lambda: lambda texts: [[float(x)] for x in texts]))
    return filled.select("vec_id", r6(F.col("embedding")[0].cast("double")).alias("first"))


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7")
def paper_lookup(t):
    papers = t("orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return ingestion.point(papers, t("customer").select("c_custkey", "c_name"), "k", "7", "c_custkey").select("o_orderkey", "o_totalprice", "c_name")


@query("SELECT conv_id, turn, CASE WHEN length(text) NOT BETWEEN 3 AND 2000 THEN 'query length' WHEN turn NOT BETWEEN 1 AND 50 THEN 'top_k' WHEN role <> 'user' THEN 'strategy' END AS problem FROM conversations")
def request_checks(t):
    rows = t("conversations").withColumn("strategy", F.when(F.col("role") == "user", "bm25").otherwise(F.col("role")))
    return ingestion.checked_request(rows, "text", "turn").select("conv_id", "turn", "problem")


@query("SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL ORDER BY doc_id")
def parent_ids(t):
    return t("labels").where("quality is not null").select("doc_id").distinct().orderBy("doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 10 = 5 THEN 'new' WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN 'new' ELSE o_orderpriority END AS priority FROM orders")
def partial_overwrite(t):
    """The new half overwrites one column; where it has nothing, the old value stays."""
    o = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    new = o.where("o_orderkey % 2 = 1").withColumn("priority", F.lit("new"))
    return upserts.partial_update(o, new, ["o_orderkey"], "priority")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 OR length(trim(l_returnflag || repeat(' ', 40) || repeat('x', l_linenumber * 8))) >= 30 GROUP BY 1")
def replace_sections(t):
    """Sections of odd papers are replaced by new ones; new ones under 30 characters are dropped."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.repeat(F.lit(" "), F.lit(40)), F.repeat(F.lit("x"), F.col("l_linenumber") * 8)).alias("text"))
    return upserts.replace_children(rows, rows.where("l_orderkey % 2 = 1"), "l_orderkey", "text").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_rows(t):
    return upserts.latest(t("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def inflight_token(t):
    return state.last_token(t("events"), "user_id", "event_id", "value")


@query("SELECT label, count(*) AS n, round(sqrt(sum(x * x)), 6) AS length FROM (SELECT label, i, avg(v) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL) GROUP BY label")
def mean_pooled(t):
    """Vectors of a label are pooled where the mask is 1: the length of the mean before it is made 1, from its first part."""
    rows = t("embeddings").groupBy("label").agg(F.collect_list(F.col("embedding").cast("array<double>")).alias("v"), F.collect_list(F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)).alias("m"))
    kept = F.transform(F.filter(F.arrays_zip("v", "m"), lambda z: z["m"] == 1), lambda z: z["v"])
    total = F.aggregate(F.slice(kept, 2, F.size(kept) - 1), kept[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    pooled = vectors.mean_pool(F.col("v"), F.col("m"))
    same = F.forall(F.zip_with(pooled, total, lambda p, x: F.abs(p * vectors.norm(total) - x)), lambda d: d < 1e-9)
    return rows.where(same & (F.abs(vectors.norm(pooled) - 1) < 1e-9)).select("label", F.size(pooled).cast("long").alias("n"), r6(vectors.norm(total) / F.size(kept)).alias("length"))


# Labels of drugs: parts


@query("SELECT p_name, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS p_partkey FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1 UNION ALL SELECT p_name, min(p_partkey) FROM part WHERE p_name LIKE 'red%' GROUP BY 1")
def newest_labels(t):
    """Names that begin with red are in the table; of the others the newest label comes in."""
    rows = t("part").select("p_name", "p_partkey", (F.col("p_retailprice") * 1000000 + F.col("p_partkey")).cast("long").alias("updated"))
    known = rows.where("p_name LIKE 'red%'").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.max("updated").alias("updated"))
    return druglabels.newest_labels(known, rows.withColumn("p_name", F.col("p_name")), "p_name", "updated").select("p_name", "p_partkey")


_LACKS = "CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type END"


@query(f"""WITH r AS (SELECT p_partkey, p_name, {_LACKS} AS mechanism, CASE WHEN p_size % 2 = 0 THEN p_brand END AS dosage FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY coalesce(mechanism = '', true) DESC, coalesce(dosage = '', true) DESC, p_partkey) AS place FROM r WHERE p_partkey % 4 <> 0 AND (p_name ILIKE '%red%' OR p_name ILIKE '%blue%') AND (coalesce(mechanism = '', true) OR coalesce(dosage = '', true)) ORDER BY place LIMIT 50""")
def backfill_candidates(t):
    rows = t("part").select("p_partkey", "p_name", F.expr(_LACKS).alias("mechanism"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("dosage"))
    found = druglabels.wanting(rows, "p_partkey", F.col("p_partkey") % 4 != 0, ["mechanism", "dosage"], "p_name", ["RED", "blue"], 50)
    lacks = [F.coalesce(F.col(c) == "", F.lit(True)).desc() for c in ("mechanism", "dosage")]
    return found.select("p_partkey", F.row_number().over(Window.orderBy(*lacks, "p_partkey")).cast("long").alias("place"))


@query(f"SELECT CASE WHEN {_LACKS} = '' THEN 'empty' WHEN {_LACKS} IS NULL THEN 'missing' ELSE 'ok' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def run_counters(t):
    value = F.expr(_LACKS)
    return druglabels.outcomes(t("part"), F.when(value == "", "empty").when(value.isNull(), "missing").otherwise("ok"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'plate' WHEN p_size % 3 = 0 THEN p_brand END AS kept FROM part")
def first_field(t):
    """The first non-blank of alternative fields, a list field giving its first element."""
    a, b = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(" plate "), F.lit("x"))), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return t("part").select("p_partkey", F.trim(tables.first_text(tables.first_element(a), F.lit("  "), b)).alias("kept"))


# Keys and jobs: customers are keys, nations their parents

_KEYS = "SELECT c_custkey AS id, 'k' || c_custkey AS key, CASE WHEN c_custkey > 25 THEN c_nationkey + 1 END AS parent_id, c_custkey % 10 = 1 AS is_admin, c_custkey % 4 = 0 AS is_revoked FROM customer"


def key_table(t):
    return t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("k"), "c_custkey").alias("key"), F.when(F.col("c_custkey") > 25, F.col("c_nationkey") + 1).cast("long").alias("parent_id"), (F.col("c_custkey") % 10 == 1).alias("is_admin"), (F.col("c_custkey") % 4 == 0).alias("is_revoked"))


@query(f"SELECT e.event_id, k.id FROM events e LEFT JOIN ({_KEYS}) k ON k.key = 'k' || e.user_id AND NOT k.is_revoked")
def key_lookup(t):
    asked = t("events").select("event_id", F.concat(F.lit("k"), "user_id").alias("key"))
    return keys.looked_up(asked, key_table(t)).select("event_id", "id")


@query(f"WITH k AS ({_KEYS}) SELECT id, (SELECT count(*) FROM k c WHERE c.parent_id = k.id AND NOT c.is_revoked) AS children FROM k WHERE NOT is_revoked")
def key_children(t):
    return keys.children(key_table(t))


@query(f"""WITH k AS ({_KEYS}), r AS (SELECT event_id, user_id AS parent_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events),
c AS (SELECT parent_id, count(*) AS n FROM k WHERE NOT is_revoked AND parent_id IS NOT NULL GROUP BY 1)
SELECT event_id, k.id IS NOT NULL AND (k.is_admin OR coalesce(c.n, 0) + turn <= 1) AS granted FROM r LEFT JOIN k ON k.id = r.parent_id AND NOT k.is_revoked LEFT JOIN c ON c.parent_id = r.parent_id""")
def key_mint(t):
    asked = t("events").select(F.col("event_id").alias("request"), F.col("user_id").alias("parent_id"))
    made = keys.mint(asked, key_table(t))
    return made.where(F.col("granted") == F.col("key").isNotNull()).select(F.col("request").alias("event_id"), "granted")


@query(f"WITH k AS ({_KEYS}) SELECT CAST(count(*) AS BIGINT) AS with_admin, (SELECT count(*) + 1 FROM k WHERE NOT is_admin OR is_revoked) AS without_admin FROM k")
def key_bootstrap(t):
    every = key_table(t)
    admin = t.spark.createDataFrame([(-1, "first", None, True, False)], every.schema)
    none = keys.bootstrap(every.where("not is_admin or is_revoked"), admin).agg(F.count("*").alias("without_admin"))
    return keys.bootstrap(every, admin).agg(F.count("*").alias("with_admin")).crossJoin(none)


_STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE NULL END"


@query(f"""WITH u AS (SELECT user_id, event_id, ts, event_type AS stage, {_STATUS} AS status FROM events), f AS (SELECT user_id, min(event_id) FILTER (status IS NOT NULL) AS last FROM u GROUP BY 1),
k AS (SELECT u.* FROM u JOIN f USING (user_id) WHERE last IS NULL OR event_id <= last) SELECT user_id, coalesce(arg_max(status, event_id) FILTER (status IS NOT NULL), 'pending') AS status, arg_max(stage, event_id) AS stage FROM k GROUP BY 1""")
def job_store(t):
    updates = t("events").select("user_id", "event_id", "ts", F.col("event_type").alias("stage"), F.expr(_STATUS).alias("status"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("error"))
    return keys.job_states(updates, "user_id", "event_id").select("user_id", "status", "stage")


@query("""WITH j AS (SELECT user_id, min(ts) AS created FROM events WHERE user_id % 2 = 0 GROUP BY 1), r AS (SELECT event_id, user_id, ts FROM events)
SELECT event_id, CASE WHEN epoch(r.ts) - epoch(created) <= 864000 THEN 200 ELSE 404 END AS code FROM r LEFT JOIN j USING (user_id)""")
def job_poll(t):
    """Only even users have a job; it is answered for ten days."""
    jobs = t("events").where("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("created"), F.lit("pending").alias("status"))
    return keys.polled(t("events").select("event_id", "user_id", "ts"), jobs, "user_id", "ts", 864000).select("event_id", "code")


@query("WITH g AS (SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT event_id, CAST(coalesce(greatest(ceil(d / 3600) - 1, 0), 0) AS BIGINT) AS beats FROM g")
def keepalive_beats(t):
    return keys.keepalives(t("events"), "user_id", "ts", "event_id", 3600).select("event_id", "beats")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS s, event_type AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, false AS hit, CASE WHEN a IN ('error', 'purchase') THEN NULL ELSE s + 43200 END AS until FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n, o.a <> 'purchase' AND coalesce(o.s < r.until, false), CASE WHEN o.a = 'purchase' THEN NULL WHEN o.s < r.until THEN r.until WHEN o.a = 'error' THEN NULL ELSE o.s + 43200 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, hit FROM r""")
def key_cache_invalidate(t):
    """Purchases invalidate the cached key, errors are look-ups that find none."""
    rows = t("events").withColumn("s", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts")) / 1e6)
    rows = rows.withColumn("what", F.when(F.col("event_type") == "purchase", "invalidate").when(F.col("event_type") == "error", "missing"))
    return state.cache_replay(rows, "user_id", "s", "event_id", 43200, action="what")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id DESC LIMIT 50")
def cache_cap(t):
    """Over the cap the entries that end first go."""
    return t("events").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), F.desc("user_id")).limit(50)


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY 1")
def fixed_chunk_cover(t):
    """Each text is covered by its fixed windows: joined without their overlaps they give it again."""
    w = chunking.fixed_windows(F.col("text"))
    again = F.array_join(F.transform(w, lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.lit(513), F.length(x["text"])))), "")
    return t("documents").where((again == F.col("text")) & (F.length(F.trim("text")) > 0)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' AB' ELSE '' END AS author FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 0")
def author_names(t):
    last, initials = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "AB")
    return t("customer").select("c_custkey", T.author_name(last, initials).alias("author"))


@query("SELECT doc_id, md5(CASE WHEN length(f) <= 300 THEN f WHEN strpos(reverse(left(f, 300)), ' .') > 0 AND 300 - strpos(reverse(left(f, 300)), ' .') - 1 > 100 THEN left(f, 300 - strpos(reverse(left(f, 300)), ' .')) WHEN strpos(reverse(left(f, 300)), ' ') > 0 THEN left(f, 300 - strpos(reverse(left(f, 300)), ' ')) || '…' ELSE left(f, 300) || '…' END) AS h FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def prose_cut(t):
    return t("documents").select("doc_id", md5(T.prose(F.col("text"), 300)).alias("h"))
