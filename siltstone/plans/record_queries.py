"""Registered queries that write ``documents`` as literature XML and read the records back; labels, names, citations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, ingestion
from siltstone.plans.registry import md5, query
from siltstone.sources import records
from siltstone.sources.tables import text_tasks

# Literature XML: every tenth entry is a book, every thirteenth has no title; dates come in four forms.

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_DATES = [("<Year>2020</Year><Month>Mar</Month><Day>7</Day>", "2020-03-07"), ("<Year>2019</Year><Month>11</Month>", "2019-11"), ("<MedlineDate>1998 Dec-1999 Jan</MedlineDate>", "1998"), ("<Year>2001</Year>", "2001")]
_AUTHORS = "<Author><LastName>Ames</LastName><Initials>B</Initials><Identifier Source=\"ORCID\">https://orcid.org/0000-0001-2345-678X</Identifier></Author><Author><CollectiveName>Group</CollectiveName></Author>"
_HEADINGS = "<MeshHeadingList><MeshHeading><DescriptorName UI=\"D1\" MajorTopicYN=\"Y\">Liver</DescriptorName></MeshHeading></MeshHeadingList>"
_CITED = "<PubmedData><ReferenceList><Reference><ArticleIdList><ArticleId IdType=\"pubmed\">77</ArticleId><ArticleId IdType=\"doi\">10.1/x</ArticleId></ArticleIdList></Reference><Reference><ArticleIdList><ArticleId IdType=\"pubmed\">Smith J. A text.</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData>"


def _escaped(c: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), _CONTROL, " ")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_ESC = f"replace(replace(replace(regexp_replace(coalesce({{c}}, ''), '{_CONTROL}', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_ART = f"""d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, ['{"', '".join(x for x, _ in _DATES)}'][doc_id % 4 + 1] AS date, ['{"', '".join(x for _, x in _DATES)}'][doc_id % 4 + 1] AS pub FROM documents),
x AS (SELECT *, '<PubmedArticle><MedlineCitation><PMID Version="1">' || id || '</PMID><Article><Journal><JournalIssue><PubDate>' || date || '</PubDate></JournalIssue><Title>' || coalesce(source, '') || '</Title></Journal><ArticleTitle>' ||
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Study <i>' || id || '</i> of
  A &amp; B.' END || '</ArticleTitle><Abstract><AbstractText Label="TEXT">' || {_ESC.format(c="text")} || '</AbstractText><AbstractText>End<sup>2</sup>.</AbstractText></Abstract><AuthorList>{_AUTHORS}</AuthorList></Article>{_HEADINGS}</MedlineCitation>{_CITED}</PubmedArticle>' AS raw,
  trim(regexp_replace(regexp_replace(coalesce(text, ''), '{_CONTROL}', ' ', 'g'), '\\s+', ' ', 'g')) AS flat FROM d)"""


def article_xml(t):
    """(xml): documents of fifty entries each, as a server sends them."""
    id_ = F.col("doc_id").cast("string")
    date = F.element_at(F.array(*(F.lit(x) for x, _ in _DATES)), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat(F.lit("Study <i>"), id_, F.lit("</i> of\n  A &amp; B.")))
    article = F.concat(
        F.lit('<PubmedArticle><MedlineCitation><PMID Version="1">'), id_, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue><Title>"), F.coalesce("source", F.lit("")),
        F.lit("</Title></Journal><ArticleTitle>"), title, F.lit('</ArticleTitle><Abstract><AbstractText Label="TEXT">'), _escaped(F.col("text")),
        F.lit(f"</AbstractText><AbstractText>End<sup>2</sup>.</AbstractText></Abstract><AuthorList>{_AUTHORS}</AuthorList></Article>{_HEADINGS}</MedlineCitation>{_CITED}</PubmedArticle>"),
    )
    book = F.concat(F.lit("<PubmedBookArticle><BookDocument><PMID Version=\"1\">"), id_, F.lit("</PMID></BookDocument></PubmedBookArticle>"))
    entry = F.struct("doc_id", F.when(F.col("doc_id") % 10 == 9, book).otherwise(article).alias("e"))
    docs = t("documents").withColumn("_set", F.floor(F.col("doc_id") / 50))
    sets = docs.repartition(text_tasks(docs), "_set").groupBy("_set").agg(F.sort_array(F.collect_list(entry)).alias("es"))
    return sets.select(F.concat(F.lit("<?xml version=\"1.0\"?><PubmedArticleSet>"), F.array_join(F.col("es.e"), "\n"), F.lit("</PubmedArticleSet>")).alias("xml"))


@query(f"""WITH {_ART} SELECT id AS pmid, 'Study ' || id || ' of A & B.' AS title, md5(CASE WHEN flat = '' THEN 'End2.' ELSE 'TEXT: ' || flat || ' End2.' END) AS abstract, pub AS pub_date, nullif(coalesce(source, ''), '') AS journal,
'Ames|B|0000-0001-2345-678X' AS first_author, 2::BIGINT AS n_authors, 'D1|Liver|true' AS headings, '77' AS cited, sha256(raw) AS checksum FROM x WHERE doc_id % 10 <> 9 AND doc_id % 13 <> 0""")
def article_records(t):
    """Records of all articles, with the digest of each one's own bytes."""
    first = F.col("authors")[0]
    headings = F.array_join(F.transform("headings", lambda h: F.concat_ws("|", h["ui"], h["name"], h["major"].cast("string"))), ",")
    return records.articles(article_xml(t), "xml").select(
        "pmid", "title", md5("abstract").alias("abstract"), "pub_date", F.nullif("journal", F.lit("")).alias("journal"), F.concat_ws("|", first["last"], first["initials"], first["orcid"]).alias("first_author"),
        F.size("authors").cast("long").alias("n_authors"), headings.alias("headings"), F.array_join("references", ",").alias("cited"), "checksum",
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 10 = 9 THEN 'skipped' WHEN doc_id % 13 = 0 THEN 'error' ELSE 'indexed' END AS status FROM documents")
def article_split(t):
    """What a batch did to each requested entry: articles, books that are skipped, and articles without a title."""
    sets = article_xml(t)
    asked = t("documents").select(F.col("doc_id").cast("string").alias("pmid"))
    return ingestion.batch_outcomes(asked, records.articles(sets, "xml"), records.books(sets, "xml"), "pmid").select("pmid", "status")


_FLAT_SQL = f"trim(regexp_replace(regexp_replace({{c}}, '{_CONTROL}', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, split_part(coalesce(text, ''), chr(10), 1) AS a FROM documents),
s AS (SELECT doc_id, 1 AS n, 'methods' AS section_type, 'How it was done' AS title, {_FLAT_SQL.format(c="a || ' and after'")} AS content FROM d UNION ALL
SELECT doc_id, 2, 'results', 'Results.', {_FLAT_SQL.format(c="substr(t, length(a) + 1)")} FROM d UNION ALL SELECT doc_id, 3, 'other', NULL, 'deep < text ' || doc_id FROM d WHERE doc_id % 3 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS section_order, section_type, title, md5(content) AS content FROM s WHERE content <> ''""")
def fulltext_sections(t):
    """Full texts with sections inside sections, figures and references: the first line, the rest, and one nine levels down."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    rest = F.substring(F.coalesce("text", F.lit("")), F.length(first) + 1, F.length("text"))
    deep = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<sec>" * 6 + "<p>deep &lt; text "), F.col("doc_id").cast("string"), F.lit("</p>" + "</sec>" * 6))).otherwise("")
    xml = F.concat(
        F.lit("<article><front><title>T</title></front><body><sec id=\"s1\" sec-type=\"materials|methods\"><title>How it was <i>done</i></title><p>"), _escaped(first), F.lit("</p><fig><caption><p>not prose</p></caption></fig><sec><title>Results.</title><p>"), _escaped(rest),
        F.lit("<xref rid=\"r1\">1</xref></p>"), deep, F.lit("</sec><p>and after</p></sec></body><back><ref-list><ref>none</ref></ref-list></back></article>"),
    )
    found = records.sections(t("documents").select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return found.select("doc_id", F.col("section_order").cast("long"), "section_type", "title", md5("content").alias("content"))


# Labels, names

_LABELS = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in ingestion.ENTITY_TYPES.items())
_NAMES = list(ingestion.ENTITY_TYPES)


@query(f"""WITH m AS (SELECT * FROM (VALUES {_LABELS}) m(label, kind)), n AS (SELECT label, kind, row_number() OVER () - 1 AS k FROM m)
SELECT kind AS entity_type, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM (SELECT doc_id, left(text, instr(text, ' ') - 1) AS w FROM documents WHERE instr(text, ' ') > 1) JOIN n ON doc_id % {len(_NAMES)} = k
WHERE kind IS NOT NULL AND length(trim(w)) >= 3 AND NOT starts_with(trim(w), '##') AND regexp_matches(trim(w), '\\p{{L}}') GROUP BY kind""")
def entity_labels(t):
    """First words tagged by every label of the tagger in turn: which become entities, and of what type."""
    end = F.instr("text", " ") - 1
    label = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    span = F.struct(label.alias("label"), F.lit(0).alias("start"), end.alias("end"), F.lit(0.9).cast("double").alias("score"))
    chunks = t("documents").where("instr(text, ' ') > 1").select("doc_id", "text", F.array(span).alias("spans"))
    found = ingestion.entities(chunks, "doc_id", "text", "spans", t("documents").where("false").select("doc_id"))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("end_char").cast("long").alias("chars"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_size, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_size || ' mg, film coated' WHEN 1 THEN p_size || '.5 ' || p_name ELSE 'x ' || p_size || 'MG/ML' END AS name FROM part),
w AS (SELECT p_partkey, array_to_string([x for x in regexp_split_to_array(trim(split_part(name, ',', 1)), '\\s+') if NOT regexp_matches(x, '^[0-9.]+$') AND NOT contains(upper(x), 'MG')], ' ') AS kept FROM p)
SELECT p_partkey, CASE WHEN length(kept) >= 3 THEN kept END AS name FROM w""")
def dose_free_names(t):
    """Names of labels without doses and forms."""
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), size, F.lit(" mg, film coated"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(".5 "), F.col("p_name"))).otherwise(F.concat(F.lit("x "), size, F.lit("MG/ML")))
    return t("part").select("p_partkey", T.dose_free(name).alias("name"))


# Citations inside sentences

_WORDS4 = r"list_distinct([lower(x) for x in regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{N}}_]+') if regexp_full_match(x, '[a-zA-Z]{{4,}}')])"


@query(rf"""WITH a AS (SELECT conv_id * 100 + turn AS answer, text, regexp_replace(text, '([.!?])(\s|$)', ' [1][2]\1\2', 'g') || ' Nothing of this kind stands there [9].' AS response FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
s AS (SELECT answer, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS sentence FROM (SELECT answer, string_split(regexp_replace(response, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM a)),
m AS (SELECT answer, place, sentence, unnest(list_distinct([CAST(y AS BIGINT) for y in regexp_extract_all(sentence, '\[(\d+)\]', 1)])) AS citation FROM s),
w AS (SELECT answer, place, citation, {_WORDS4.format(c="replace(sentence, '[' || citation || ']', '')")} AS c FROM m),
i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n, {_WORDS4.format(c="text")} AS ws FROM benchmark),
p AS (SELECT answer, 1 AS number, {_WORDS4.format(c="text")} AS ws FROM a UNION ALL SELECT answer, 2, ws FROM a JOIN i ON a.answer % i.n = i.k),
j AS (SELECT w.*, ws FROM w LEFT JOIN p ON p.answer = w.answer AND p.number = w.citation)
SELECT severity, citation, count(*) AS n FROM (SELECT citation, CASE WHEN citation NOT BETWEEN 1 AND 2 THEN 'invalid' ELSE 'weak' END AS severity FROM j
WHERE citation NOT BETWEEN 1 AND 2 OR len(c) > 0 AND len(ws) > 0 AND len(list_intersect(c, ws)) / len(c) < 0.05) GROUP BY ALL""")
def citation_overlap(t):
    """Every sentence cites the turn it is from and an unrelated passage, one more cites none that is there."""
    turns = t("conversations").where("role = 'assistant' and text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer"), "text")
    said = F.concat(F.regexp_replace("text", r"([.!?])(\s|$)", r" [1][2]$1$2"), F.lit(" Nothing of this kind stands there [9]."))
    rows = turns.select("answer", said.alias("response"))
    items = t("benchmark").withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1)  # the benchmark's items are few
    other = turns.withColumn("k", F.pmod(F.col("answer"), F.lit(items.count()))).join(items.select("k", F.col("text").alias("passage")), "k")
    passages = turns.select("answer", F.lit(1).cast("long").alias("number"), "text").unionByName(other.select("answer", F.lit(2).cast("long").alias("number"), F.col("passage").alias("text")))
    return answer.verify(rows, passages, "answer", "response", "number", "text").groupBy("severity", "citation").agg(F.count("*").alias("n"))
