"""Classifiers, language model and token counts."""

import collections
import math
import zlib

import pytest

from siltstone.llm.language_model import score_documents
from siltstone.llm.quality import quality
from siltstone.llm.token_counts import token_counts
from siltstone.llm.toxicity import toxicity, without_toxic

TOKENIZERS = pytest.importorskip("public_tokenizers")


def read(spark, name, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_quality_held_out(spark):
    got = quality(read(spark, "documents"), read(spark, "labels")).join(read(spark, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_held_out_and_spans(spark):
    docs = read(spark, "documents")
    found = toxicity(docs, read(spark, "labels"))
    got = found.join(read(spark, "labels"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").collect()
    clean = [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean) and any(r["predicted"] for r in got)
    for r in got:
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(r["text"]) and "\n" not in r["text"][s["start"] : s["end"]]


@pytest.mark.parametrize("f,column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, f, column):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b.", "x"), (2, "word " * 20000, "x")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    assert all(0 <= r["score"] <= 1 for r in f(docs, none).collect())
    some = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 0), (4, 1)], f"doc_id long, {column} int")
    got = f(docs, some).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert f(docs.where("false"), some).collect() == []


def test_without_toxic_keeps_columns(spark):
    docs = read(spark, "documents").selectExpr("doc_id", "text", "lang AS c0", "source AS text_again", "n_chars")
    labels = read(spark, "labels")
    kept = without_toxic(docs, labels)
    want = toxicity(docs, labels).where("predicted = 0")
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect())


@pytest.mark.parametrize("table_words", [1 << 20, 500])
def test_language_model(spark, table_words):
    docs = read(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text").unionByName(spark.createDataFrame([(7001, None), (7002, ""), (7003, "zzz qqq"), (7003, "zzz qqq")], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_id = dict(rows)
    got = score_documents(docs, head_words=300, table_words=table_words).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens(by_id[r["doc_id"]])
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_without_rows(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, tmp_path, file):
    texts = [(1, "Hello  world <s> </s>"), (2, None), (3, ""), (3, "Hello  world <s> </s>"), (4, "<|endoftext|> é\n\n x "), (None, "b"), (5, "word " * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    path, cache = TOKENIZERS.path(file), str(tmp_path / "cache")
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    for _ in range(2):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(df, path, cache).collect())
        assert got == sorted((str(i), len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in texts)
    (version,) = [p for p in (tmp_path / "cache").iterdir()]
    assert spark.read.parquet(str(version)).count() == 5  # the second run found every digest stored


def test_toxicity_without_telling_features(spark):
    docs = spark.createDataFrame([(k, f"own{k} word{k}.") for k in range(1, 9)] + [(3, "again.")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 11 and all(r["score"] == 0 and r["predicted"] == 0 and r["spans"] == [] for r in got)


def test_token_cache_with_repeated_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path, cache = TOKENIZERS.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts(df, path, cache).collect()))
    (version,) = [p for p in (tmp_path / "cache").iterdir()]
    spark.read.parquet(str(version)).write.parquet(str(tmp_path / "twice"))
    spark.read.parquet(str(tmp_path / "twice")).write.mode("append").parquet(str(version))
    again = token_counts(df.withColumn("digest", df["text"]).withColumn("n_tokens", df["doc_id"]), path, cache)
    assert sorted(map(tuple, again.collect())) == first
    assert token_counts(df.where("false"), path, cache).collect() == []
