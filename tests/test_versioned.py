"""Two writers at once, commits of several tables, broken commits, files that stay."""

import threading

import pytest
from pyspark.sql import functions as F

from siltstone.sources.versioned import Conflict, Files, VersionedTables

QUEUE = "pmid long, status string, queued_at long, claimed_by string"


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/tables")


def test_two_claimers_never_get_one_key(spark, tables):
    rows = spark.createDataFrame([(k, "queued" if k % 5 else "done", -k, None) for k in range(100)], QUEUE)
    tables.commit(lambda _: {"log": rows}, {"log": ["pmid"]}, buckets=4)
    got: dict[str, list] = {"a": [], "b": []}

    def work(name: str) -> None:
        own = VersionedTables(spark, tables.folder)
        while some := own.claim("log", "status", "queued", "fetching", ["queued_at", "pmid"], 15, name).collect():
            got[name].append([r["pmid"] for r in some])

    writers = [threading.Thread(target=work, args=(n,)) for n in got]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    every = [k for claims in got.values() for some in claims for k in some]
    assert sorted(every) == [k for k in range(100) if k % 5] and len(set(every)) == len(every)
    after = {r["pmid"]: (r["status"], r["claimed_by"]) for r in tables.at().read("log").collect()}
    assert all(after[k] == ("fetching", name) for name, claims in got.items() for some in claims for k in some)
    assert all(after[k] == ("done", None) for k in range(0, 100, 5)) and tables.last() == 1 + sum(map(len, got.values()))
    # The version before is still what it was.
    assert tables.at(1).read("log").where("status = 'queued'").count() == 80


def test_tables_change_together_and_files_stay(spark, tables):
    papers = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id long, title string")
    links = spark.createDataFrame([(k, k + 1) for k in range(50)], "id long, cited long")
    keys = {"papers": ["id"], "links": ["id", "cited"]}
    assert tables.commit(lambda _: {"papers": papers, "links": links}, keys, buckets=8)[0] == 1
    first = tables.at()
    change = {"papers": spark.createDataFrame([(3, "new"), (99, "more")], "id long, title string"), "links": spark.createDataFrame([(99, 3)], "id long, cited long")}
    assert tables.commit(lambda _: change, keys)[0] == 2
    second = tables.at()
    assert {r["id"]: r["title"] for r in second.read("papers").collect()} == {k: f"t{k}" for k in range(50)} | {3: "new", 99: "more"}
    assert second.read("links").count() == 51 and first.read("papers").count() == 50
    moved = [b for b in first.files("papers") if second.files("papers").get(b) != first.files("papers")[b]]
    assert 1 <= len(moved) <= 2 and second.read("papers", moved).count() < 52


def test_a_broken_commit_leaves_the_old_version(spark, tables):
    papers = spark.createDataFrame([(1, "one")], "id long, title string")
    tables.commit(lambda _: {"papers": papers}, {"papers": ["id"]})
    broken = papers.select("id", F.raise_error(F.lit("lost")).cast("string").alias("title"))
    with pytest.raises(Exception, match="lost"):
        tables.commit(lambda _: {"papers": papers.withColumn("title", F.lit("two")), "links": broken}, {"links": ["id"]})
    assert tables.last() == 1 and [tuple(r) for r in tables.at().read("papers").collect()] == [(1, "one")] and tables.at().tables() == ["papers"]
    # What a writer left that stopped before its manifest is not seen, and the next commit goes through.
    tables._written(tables.at(), {"papers": papers.withColumn("title", F.lit("half"))}, {}, 4, "data/stopped")
    assert tables.commit(lambda v: {"papers": v.read("papers").withColumn("title", F.lit("three"))})[0] == 2
    assert tables.at().read("papers").first()["title"] == "three"


def test_the_loser_tries_again_on_the_winners_version(spark, tables):
    count = spark.createDataFrame([(1, 0)], "id long, n long")
    tables.commit(lambda _: {"count": count}, {"count": ["id"]})
    seen = []

    def change(before):
        seen.append(before.number)
        if len(seen) == 1:
            VersionedTables(spark, tables.folder).commit(lambda v: {"count": v.read("count").withColumn("n", F.col("n") + 10)})
        return {"count": before.read("count").withColumn("n", F.col("n") + 1)}

    assert tables.commit(change)[0] == 3 and seen == [1, 2] and tables.at().read("count").first()["n"] == 11

    def beaten(before):
        VersionedTables(spark, tables.folder).commit(lambda v: {"count": v.read("count").withColumn("n", F.col("n") + 1)})
        return {"count": before.read("count")}

    with pytest.raises(Conflict):
        tables.commit(beaten, attempts=2)


def test_nothing_to_commit_and_put_if_absent(spark, tables, tmp_path):
    none = spark.createDataFrame([], "id long, n long")
    assert tables.commit(lambda _: {"t": none}, {"t": ["id"]})[0] == 0 and tables.at().tables() == []
    files = Files(spark, f"file://{tmp_path}")
    (tmp_path / "log").mkdir()
    assert files.put_if_absent(f"file://{tmp_path}/log/1.json", "a") and not files.put_if_absent(f"file://{tmp_path}/log/1.json", "b")
    assert files.read(f"file://{tmp_path}/log/1.json") == "a" and [n for n in files.names(f"file://{tmp_path}/log") if not n.startswith(".")] == ["1.json"]
