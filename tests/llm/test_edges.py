"""Long texts, clashing column names, many sources, repeated runs, and the directory of shards against a plain one."""

import collections

import pytest
from pyspark.sql import functions as F

from siltstone.llm.decontamination import contaminated
from siltstone.llm.language_model import score_documents
from siltstone.llm.mixing import MAX_PASSES, mix
from siltstone.llm.sharding import shard


def test_contaminated_long_texts_and_a_common_passage(spark):
    common = " ".join(f"p{k}" for k in range(30))
    items = [(k, f"{common} own{k} tail{k} end{k}") for k in range(20)] + [(50, "short item"), (51, common)]
    docs = [(k, f"head{k} {common}") for k in range(200)] + [(900, "x " * 60_000 + items[3][1] + " y" * 60_000), (901, "a short item here"), (902, "short"), (903, None)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("s", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    found = collections.defaultdict(set)
    for r in got.collect():
        found[r["doc_id"]].add(r["item_id"])
    # 26 of the 29 shingles of an item with its own end are the passage's: 0.897.
    every = set(range(20)) | {51}
    assert all(found[k] == every for k in range(200)) and found[900] == every and found[901] == {50} and 902 not in found and 903 not in found


def test_language_model_reruns_and_names(spark):
    rows = [(k, f"the cat number{k % 7} sat on the mat{k % 3}", "n", 1) for k in range(60)] + [(900, "the cat sat " * 60_000, "n", 1), (None, "the cat", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, held int")
    runs = [sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 2)) for r in score_documents(d).collect()) for d in (df, df)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert next(r for r in runs[0] if r[0] == "900")[1] == 180_001


def test_mix_many_sources_and_names(spark):
    rows = [(k, "w " * (k % 17 + 1), f"s{k % 300}", 1, 1.0, "x") for k in range(1500)] + [(9000, "w " * 50_000, "s1", 1, 1.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass int, mix_position double, range string")
    placed = mix(df).placed().collect()
    taken, target = collections.Counter(), {}
    for r in placed:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= MAX_PASSES * r["size"] and r["copies"] == len(r["mix_places"])
    assert len(placed) == len(rows) and len(target) == 300
    order = {s: k % 3 + 1 for k, s in enumerate(sorted(target))}
    open_ = [s for s in target if s != "s1" and target[s] < 3 * sum(r["size"] for r in placed if r["source"] == s) - 1e-6]
    assert len({round(target[s] / order[s], 6) for s in open_}) <= 1
    assert sum(abs(taken[s] - target[s]) <= 17 for s in target if s != "s1") == 299


@pytest.mark.parametrize("limit", [300, 2000])
def test_shards_against_a_plain_directory(spark, limit):
    rows = [(k, "x" * (k * 7 % 90)) for k in range(500)] + [(1, "same " * 20)] * 80
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard_id"]] += r["row_bytes"]
    # A plain directory over the same leaves: every inner node was over the limit, so none was split in vain.
    inner = {name[:d] for name in sizes for d in range(len(name))}
    below = {p: sum(n for s, n in sizes.items() if s.startswith(p)) for p in inner}
    start = min((len(n) for n in sizes), default=0)
    assert all(n > limit for p, n in below.items() if len(p) >= start) and all(n <= limit for n in sizes.values())
