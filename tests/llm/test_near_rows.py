"""Near duplicates are decided by row: null and reused ids keep one document of each group."""

import corpus_pipeline as cp


def test_null_and_reused_ids(spark, sf):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(30)) for w in ("ant", "bee", "cat", "dog"))
    rows = [
        (None, one), (None, two), (None, three),  # unlinked documents without an id
        (1, four), (9, four + " end"), (9, "fish " * 3 + "alone"),  # 9 is linked to 1 in one text only
        (5, "gnu " + one), (5, "hare"), (5, "hare"), (5, "ibis"),  # a reused id, with a repeat; one is linked to a null id
        (7, ""), (7, ""), (7, None), (8, " "), (None, ""), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs.repartition(3), sf)
    assert kept.columns == docs.columns
    want = [(None, two), (None, three), (1, four), (9, "fish " * 3 + "alone"), (5, "gnu " + one), (5, "hare"), (5, "ibis"), (7, ""), (7, None), (8, " "), (None, ""), (None, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
