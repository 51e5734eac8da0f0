"""Record parsers: literature XML, full-text XML and drug-label JSON to typed rows; a bad record is dropped, not the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import SECTIONS, section_type
from siltstone.sources.tables import first_element, first_text, parsed

# Month names, marks inside a text of a literature record, and elements of a full text that are not prose.
MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
INLINE = r"</?(?:b|i|u|sub|sup|DispFormula|mml:\w+)(?:\s[^<>]*)?/?>"
NOT_PROSE = ("fig", "table-wrap", "table", "ref-list", "ref", "xref")

_VALUE = "struct<_VALUE:string,_Label:string,_UI:string,_MajorTopicYN:string,_IdType:string>"
_DATE = "struct<Year:string,Month:string,Day:string,MedlineDate:string>"
_ABSTRACT = f"struct<AbstractText:array<{_VALUE}>>"
#: What is read of an article element; the fields may also stand directly below it, as in excerpts.
ARTICLE_XML = (
    f"PMID {_VALUE}, ArticleTitle string, Abstract {_ABSTRACT}, PubDate {_DATE}, MedlineCitation struct<PMID:{_VALUE},"
    f"Article:struct<ArticleTitle:string,Abstract:{_ABSTRACT},Journal:struct<Title:string,JournalIssue:struct<PubDate:{_DATE}>>,Language:array<string>,"
    "AuthorList:struct<Author:array<struct<LastName:string,Initials:string,Identifier:array<string>>>>,GrantList:struct<Grant:array<struct<Agency:string>>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:{_VALUE}>>>>,"
    f"PubmedData struct<ReferenceList:array<struct<Reference:array<struct<ArticleIdList:array<struct<ArticleId:array<{_VALUE}>>>>>>>>"
)


def _flat(text: Column) -> Column:
    """Runs of white space as one space; null for nothing."""
    return F.nullif(_squeezed(text), F.lit(""))


def _squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def _date(d: Column) -> Column:
    """Year[-Month[-Day]] with a numeric month, or the first four characters of a free-form date."""
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    digits = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int"))
    month = F.coalesce(F.try_element_at(months, F.lower(F.left(d["Month"], F.lit(3)))), digits(d["Month"]))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    day = F.when(month.isNotNull(), two(digits(d["Day"])))
    free = F.nullif(F.left(d["MedlineDate"], F.lit(4)), F.lit(""))
    return F.when(F.coalesce(d["Year"], F.lit("")) != "", F.concat_ws("-", d["Year"], two(month), day)).otherwise(free)


def raw_articles(batches: DataFrame, xml: str) -> DataFrame:
    """(raw): the article elements in the documents of column ``xml``, byte for byte."""
    return batches.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<PubmedArticle[\s>].*?</PubmedArticle>"), F.lit(0))).alias("raw"))


def articles(batches: DataFrame, xml: str) -> DataFrame:
    """Typed rows of all article elements in the documents of column ``xml``, with the digest of the element's own bytes.

    A record that is not well-formed, or has no valid id or title, is left out, the others of its document are not.
    """
    # Marks inside a text would make its element a structure; without them it is read as a value.
    rows = parsed(raw_articles(batches, xml), "r", F.from_xml(F.regexp_replace("raw", INLINE, ""), ARTICLE_XML))
    m, a = F.col("r.MedlineCitation"), F.col("r.MedlineCitation.Article")
    pmid = F.coalesce(m["PMID"]["_VALUE"], F.col("r.PMID._VALUE"))
    title = _flat(F.coalesce(a["ArticleTitle"], F.col("r.ArticleTitle")))
    texts = F.coalesce(a["Abstract"], F.col("r.Abstract"))["AbstractText"]
    parts = F.filter(F.transform(texts, lambda t: F.struct(t["_Label"].alias("label"), _squeezed(t["_VALUE"]).alias("text"))), lambda t: t["text"] != "")
    labelled = F.filter(parts, lambda t: t["label"].isNotNull())
    orcid = lambda x: F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(x["Identifier"], F.lit(1)), F.lit("")), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\s*$", 1), F.lit(""))
    author = lambda x: F.struct(x["LastName"].alias("last"), F.nullif(F.left(x["Initials"], F.lit(20)), F.lit("")).alias("initials"), orcid(x).alias("orcid"))
    heading = lambda h: F.struct(h["DescriptorName"]["_UI"].alias("ui"), h["DescriptorName"]["_VALUE"].alias("name"), (h["DescriptorName"]["_MajorTopicYN"] == "Y").alias("major"))
    none = F.array()
    cited = _cited(F.col("r.PubmedData.ReferenceList"))
    return rows.select(
        F.btrim(pmid).alias("pmid"), title.alias("title"),
        F.nullif(F.array_join(F.transform(parts, lambda t: F.concat_ws(": ", t["label"], t["text"])), " "), F.lit("")).alias("abstract"),
        F.map_from_entries(F.array_distinct(F.coalesce(_last_of(labelled), none.cast("array<struct<label:string,text:string>>")))).alias("sections"),
        _date(F.coalesce(a["Journal"]["JournalIssue"]["PubDate"], F.col("r.PubDate"))).alias("pub_date"),
        a["Journal"]["Title"].alias("journal"), F.coalesce(F.try_element_at(a["Language"], F.lit(1)), F.lit("eng")).alias("language"),
        F.coalesce(F.transform(a["AuthorList"]["Author"], author), none.cast("array<struct<last:string,initials:string,orcid:string>>")).alias("authors"),
        F.coalesce(F.transform(m["MeshHeadingList"]["MeshHeading"], heading), none.cast("array<struct<ui:string,name:string,major:boolean>>")).alias("headings"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce(a["GrantList"]["Grant"]["Agency"], none.cast("array<string>")), lambda g: F.coalesce(g, F.lit("")) != ""))).alias("agencies"),
        cited.alias("references"), F.sha2(F.col("raw").cast("binary"), 256).alias("checksum"),
    ).where(F.col("pmid").rlike(r"^\d{1,20}$") & F.col("title").isNotNull())


def _last_of(labelled: Column) -> Column:
    """Of entries that share a label the last one, as a map keeps it."""
    later = lambda t, i: ~F.exists(F.slice(labelled, i + 2, F.size(labelled)), lambda u: u["label"] == t["label"])
    return F.filter(labelled, later)


def _cited(lists: Column) -> Column:
    """Ids of the cited records; citations whose text stands in place of an id are none."""
    references = F.flatten(F.filter(F.transform(lists, lambda x: x["Reference"]), lambda x: x.isNotNull()))
    ids = F.flatten(F.filter(F.transform(references, lambda x: F.flatten(x["ArticleIdList"]["ArticleId"])), lambda x: x.isNotNull()))
    good = F.filter(ids, lambda i: (i["_IdType"] == "pubmed") & i["_VALUE"].rlike(r"^\d{1,20}$"))
    return F.coalesce(F.transform(good, lambda i: i["_VALUE"]), F.array().cast("array<string>"))


def books(batches: DataFrame, xml: str) -> DataFrame:
    """(pmid): entries that are no articles, so that they can be marked as skipped."""
    raw = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<PubmedBookArticle[\s>].*?</PubmedBookArticle>"), F.lit(0)))
    return batches.select(raw.alias("raw")).select(F.regexp_extract("raw", r"<PMID[^>]*>\s*(\d{1,20})\s*</PMID>", 1).alias("pmid")).where("pmid <> ''")


def _prose(xml: Column) -> Column:
    """The text of XML without elements that are not prose and without marks, entities as characters."""
    kept = xml
    for tag in NOT_PROSE:
        kept = F.regexp_replace(kept, rf"(?s)<{tag}(?:\s[^<>]*)?/>|<{tag}(?:\s[^<>]*)?>.*?</{tag}\s*>", " ")
    kept = F.regexp_replace(kept, r"<[^<>]*>", " ")
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        kept = F.replace(kept, F.lit(f"&{entity};"), F.lit(char))
    return F.coalesce(_flat(kept), F.lit(""))


#: The title that a section begins with, and the marks where sections begin and end.
_TITLE = r"(?s)^\s*(?:<label(?:\s[^<>]*)?>.*?</label\s*>\s*)?<title(?:\s[^<>]*)?>(.*?)</title\s*>"
_SEC = r"<sec(?:\s[^<>]*[^/<>])?>|</sec\s*>"


def sections(docs: DataFrame, id_col: str, xml: str) -> DataFrame:
    """(``id_col``, section_order, section_type, title, content) of the sections of a body, nested ones after their parent.

    Sections nest to any depth; what stands in one belongs to it wherever its own sections stand.  Sections without prose and
    texts without an article's body give no rows.
    """
    body = F.regexp_extract(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"(?s)<article[\s>].*?<body(?:\s[^<>]*)?>(.*)</body\s*>", 1)
    rows = docs.where(F.col(xml).isNotNull()).select(id_col, body.alias("_b")).where("_b <> ''")
    rows = rows.select(id_col, F.regexp_extract_all("_b", F.lit(_SEC), F.lit(0)).alias("_tags"), F.split("_b", _SEC).alias("_texts"))
    # Which section each piece of text is in: the innermost one that is open, by a stack of their numbers.
    begin = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(got: Column, tag: Column) -> Column:
        down = F.startswith(tag, F.lit("<sec"))
        n = got["n"] + F.when(down, 1).otherwise(0)
        open_ = F.when(down, F.concat(got["open"], F.array(n))).otherwise(F.slice(got["open"], 1, F.greatest(F.size(got["open"]) - 1, F.lit(0))))
        return F.struct(open_.alias("open"), n.alias("n"), F.concat(got["of"], F.array(F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit(0)))).alias("of"))

    of = F.aggregate("_tags", begin, step, lambda got: got["of"])
    piece = F.posexplode(F.arrays_zip(of.alias("of"), F.col("_tags").alias("tag"), F.slice("_texts", 2, F.size("_tags")).alias("text")))
    pieces = rows.select(id_col, piece.alias("at", "p")).where("p.of > 0")
    listed = F.sort_array(F.collect_list(F.struct("at", F.col("p.tag").alias("tag"), F.col("p.text").alias("text"))))
    found = pieces.groupBy(id_col, F.col("p.of").alias("n")).agg(listed.alias("s"))
    own = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    title_xml = F.regexp_extract(own, _TITLE, 1)
    content = _prose(F.regexp_replace(own, _TITLE, " "))
    title = F.nullif(_prose(title_xml), F.lit(""))
    given = F.lower(F.regexp_extract(F.col("s")[0]["tag"], r"""sec-type\s*=\s*["']([^"']*)""", 1))
    kind = section_type(F.regexp_replace(F.coalesce(title, F.lit("")), r"\.$", ""))
    for name in reversed(sorted(set(SECTIONS.values()))):
        kind = F.when(F.contains(given, F.lit(name)), name).otherwise(kind)
    some = found.select(id_col, "n", kind.alias("section_type"), title.alias("title"), content.alias("content")).where("content <> ''")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("n")) - 1
    return some.select(id_col, order.alias("section_order"), "section_type", "title", "content")


_HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"


def _bare(html: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def html_sections(html: Column) -> Column:
    """array<struct<level, title, section_type, text>>: each heading h1 to h6 with the text up to the next, without tags."""
    heads, bodies = F.regexp_extract_all(html, F.lit(_HEADING), F.lit(0)), F.split(html, _HEADING)
    level = lambda h: F.regexp_extract(h, "(?i)<h([1-6])", 1).cast("int")
    one = lambda h, i: F.struct(level(h).alias("level"), _bare(h).alias("title"), section_type(_bare(h)).alias("section_type"), _bare(bodies[i + 1]).alias("text"))
    return F.transform(heads, one)


def drug_labels(raw: DataFrame) -> DataFrame:
    """Label rows from parsed label JSON: first elements of list fields, alternatives coalesced, newest of a generic name."""
    g, text = F.col("openfda.generic_name"), lambda *names: first_text(*(first_element(F.col(n)) for n in names))
    return raw.select(
        F.lower(first_element(g)).alias("generic_name"), F.coalesce("openfda.brand_name", F.array().cast("array<string>")).alias("brand_names"),
        text("indications_and_usage", "purpose").alias("indications_and_usage"), text("mechanism_of_action", "clinical_pharmacology").alias("mechanism_of_action"), "effective_time",
    ).where("generic_name is not null")
