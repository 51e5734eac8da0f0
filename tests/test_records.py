"""Literature XML: broken records, dates, marks inside texts, cited ids; full texts with sections in sections."""

import hashlib

from siltstone.sources import records


def articles(spark, *docs):
    return {r["pmid"]: r for r in records.articles(spark.createDataFrame([(d,) for d in docs], "x string"), "x").collect()}


def article(pmid, title="T", more="", journal=""):
    return f"<PubmedArticle>\n<MedlineCitation><PMID>{pmid}</PMID><Article><Journal>{journal}</Journal><ArticleTitle>{title}</ArticleTitle>{more}</Article></MedlineCitation></PubmedArticle>"


def test_a_broken_record_goes_alone(spark):
    good, bad = article(1), "<PubmedArticle><MedlineCitation><PMID>2</PMID></Article></PubmedArticle>"
    got = articles(spark, f"<S>{good}{bad}{article(3, '')}{article('x4')}{article(5)}</S>", None, "", "no xml")
    assert got.keys() == {"1", "5"} and got["1"]["checksum"] == hashlib.sha256(good.encode()).hexdigest()
    assert got["1"]["authors"] == [] and got["1"]["abstract"] is None and got["1"]["language"] == "eng" and got["1"]["sections"] == {}


def test_fields_of_a_record(spark):
    dates = ["<Year>2020</Year><Month>February</Month>", "<Year>2020</Year><Month>2</Month><Day>9</Day>", "<Year>2020</Year><Month>Spring</Month><Day>9</Day>", "<MedlineDate>2011 Jan-Feb</MedlineDate>", ""]
    got = articles(spark, "<S>" + "".join(article(k, journal=f"<JournalIssue><PubDate>{d}</PubDate></JournalIssue><Title>J</Title>") for k, d in enumerate(dates)) + "</S>")
    assert [got[str(k)]["pub_date"] for k in range(5)] == ["2020-02", "2020-02-09", "2020", "2011", None] and got["0"]["journal"] == "J"
    more = (
        "<Abstract><AbstractText Label='A'>one <b>two</b>\n three &lt; four</AbstractText><AbstractText>five</AbstractText><AbstractText Label='A'>six</AbstractText></Abstract><Language>fre</Language>"
        "<GrantList><Grant><Agency>NIH</Agency></Grant><Grant><Agency>CDC</Agency></Grant><Grant><Agency>NIH</Agency></Grant><Grant/></GrantList>"
    )
    r = articles(spark, article(7, "H<sub>2</sub>O &amp; <i>x</i>", more))["7"]
    assert r["title"] == "H2O & x" and r["abstract"] == "A: one two three < four five A: six" and r["sections"] == {"A": "six"}
    assert r["language"] == "fre" and r["agencies"] == ["CDC", "NIH"] and r["references"] == []


def test_books(spark):
    df = spark.createDataFrame([(f"<S>{article(1)}<PubmedBookArticle><BookDocument><PMID Version='1'>9</PMID></BookDocument></PubmedBookArticle></S>",)], "x string")
    assert [r["pmid"] for r in records.books(df, "x").collect()] == ["9"]


def test_sections_in_sections(spark):
    deep = "".join(f"<sec id='d{k}'><title>Level {k}</title><p>text {k}</p>" for k in range(12)) + "</sec>" * 12
    body = (
        f"<article><body><sec sec-type='intro'><title>Introduction</title><p>a &amp; b</p>{deep}<p>after</p></sec><sec/><sec><title>Discussion.</title><fig><title>no</title><p>no</p></fig></sec>"
        "<sec><label>3</label><title>Results</title><table-wrap><table><tr><td>no</td></tr></table></table-wrap><p>yes<xref>1</xref>, it is</p></sec></body></article>"
    )
    df = spark.createDataFrame([(1, body), (2, "<article></article>"), (3, None), (4, "plain")], "id long, x string")
    got = sorted((r["id"], r["section_order"], r["section_type"], r["title"], r["content"]) for r in records.sections(df, "id", "x").collect())
    assert [g[1] for g in got] == list(range(14)) and {g[0] for g in got} == {1}
    assert got[0][3:] == ("Introduction", "a & b after") and [g[3:] for g in got[1:13]] == [(f"Level {k}", f"text {k}") for k in range(12)]
    assert got[13][2:] == ("results", "Results", "yes , it is")
