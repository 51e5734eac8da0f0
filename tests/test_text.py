import pytest
from pyspark.sql import functions as F

from siltstone.functions import stemmer
from siltstone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q,bare", [("tell me about muscle growth?", "muscle growth"), ("How do muscles grow", "muscles grow"), ("what is lupus", "lupus"), ("lupus", "lupus"), ("what is ", "what is "), ("please explain to me BMI.", "BMI")])
def test_strip_filler(spark, q, bare):
    assert one(spark, T.strip_filler(F.lit(q))) == bare


@pytest.mark.parametrize("spec,provider,model", [("nim", "nim", None), ("NIM/Llama", "nim", "Llama"), ("a/b/c", "a", "b/c"), (None, "extractive", None), ("", "extractive", None), ("odd", "odd", None)])
def test_provider_spec(spark, spec, provider, model):
    assert tuple(one(spark, T.provider_spec(F.lit(spec).cast("string")))) == (provider, model)


@pytest.mark.parametrize("q,kind,k", [("drug a vs drug b", "comparative", 10), ("How does it work", "exploratory", 12), ("what is x", "factual", 5), ("zzz", "exploratory", 10), ("is A better than B", "comparative", 10)])
def test_classify(spark, q, kind, k):
    got = one(spark, T.classify(F.lit(q)))
    assert (got["query_type"], got["top_k"]) == (kind, k)


@pytest.mark.parametrize("title,kind", [("Materials and Methods.", "methods"), ("RESULTS", "results"), ("Something", "other"), ("Concluding remarks", "conclusion")])
def test_section_type(spark, title, kind):
    assert one(spark, T.section_type(F.lit(title))) == kind


def test_slug_and_sentences(spark):
    assert one(spark, T.slug(F.lit("  IL-6 (human)! "))) == "il-6-human"
    assert one(spark, T.slug(F.lit("!!!"))) == "node"
    assert one(spark, T.sentences(F.lit("A b. C d?  E"))) == ["A b.", "C d?", "E"]
    assert one(spark, T.markers(F.lit("x [1][12] y [0]"))) == [1, 12, 0]


def test_terms_patterns_and_names(spark):
    terms = T.content_terms(F.lit("What drug helps muscle relaxation"))
    assert one(spark, terms) == ["muscle", "relaxation"]
    assert one(spark, T.phrase_patterns(terms)) == ["%muscle%relaxation%", "%muscle%relax%"]
    assert one(spark, T.phrase_patterns(F.array(F.lit("one")))) == []
    assert one(spark, T.dose_free(F.lit("Aspirin 500 MG tablet, coated"))) == "Aspirin tablet"
    assert one(spark, T.drug_shaped(F.lit("atorvastatin"))) and not one(spark, T.drug_shaped(F.lit("cat")))
    assert one(spark, T.authors_short(F.array(F.lit(None).cast("string")))) == "Unknown"
    assert one(spark, T.authors_short(F.array(F.lit("A"), F.lit("B")))) == "A, B"
    assert one(spark, T.clean_orcid(F.lit("https://orcid.org/0000-0001-2345-678X"))) == "0000-0001-2345-678X"
    assert str(one(spark, T.compact_date(F.lit("20210131")))) == "2021-01-31" and one(spark, T.compact_date(F.lit("20211340"))) is None
    assert one(spark, T.search_terms(F.lit("Abc"), F.array(F.lit("ABC"), F.lit("x"), F.lit("y" * 61)))) == ["Abc", "x"]


def test_prose(spark):
    assert one(spark, T.prose(F.lit("a  b\nc"), 10)) == "a b c"
    assert one(spark, T.prose(F.lit("First one. Second two"), 14)) == "First one."
    assert one(spark, T.prose(F.lit("alpha beta gamma"), 12)) == "alpha beta…"


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("adjustment", "adjust"), ("controlling", "control"), ("agreed", "agre"), ("sky", "sky")])
def test_stem(word, stem):
    assert stemmer.stem(word) == stem
