"""Streams of keys and jobs: restarts repeat nothing, timers clear what is over, jobs expire."""

import datetime as dt

import pytest

from siltstone.streaming import processors

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def streams(spark, tmp_path):
    """Runs ``process`` over arrivals of rows, one after the other; the rows that each run added."""
    own = processors.with_state_store(spark)

    def run(schema, process, arrivals, late="10 seconds"):
        added, before = [], []
        for rows in arrivals:
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = own.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", late)
            processors.run_available(process(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
            now = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
            rest = list(now)
            for r in before:
                rest.remove(r)
            added.append(rest)
            before = now
        return added

    return run


def at(second):
    return T0 + dt.timedelta(seconds=second)


def test_cache_over_restarts(streams):
    schema = "k string, ts timestamp, n long, what string"
    arrivals = [
        [("a", at(0), 1, ""), ("a", at(30), 2, ""), ("b", at(30), 3, "missing")],
        [("a", at(59), 4, ""), ("a", at(60), 5, ""), ("b", at(61), 6, "")],
        [],
        [("a", at(61), 7, "invalidate"), ("a", at(62), 8, ""), ("b", at(70), 9, ""), ("b", at(200), 10, ""), ("b", at(201), 11, "missing"), ("b", at(261), 12, "missing"), ("b", at(262), 13, "")],
    ]
    got = streams(schema, lambda s: processors.key_cache_stream(s, "k", "ts", "n", "what", 60), arrivals)
    assert [[(n, hit) for _, n, hit in sorted(rows, key=lambda r: r[1])] for rows in got] == [
        [(1, False), (2, True), (3, False)],
        [(4, True), (5, False), (6, False)],
        [],
        [(7, False), (8, False), (9, True), (10, False), (11, True), (12, False), (13, False)],
    ]


def test_jobs_are_final_and_expire(streams):
    schema = "k string, ts timestamp, n long, status string, stage string, payload string, error string"
    arrivals = [
        [("a", at(0), 1, None, "fetch", None, None), ("a", at(1), 2, "running", None, "p", None), ("b", at(1), 3, None, None, None, None)],
        [("a", at(5), 4, "done", "last", None, None), ("a", at(6), 5, "error", None, None, "late")],
        [("a", at(7), 6, "running", None, None, None), ("c", at(900), 7, "running", None, None, None)],
        [("c", at(901), 8, None, "second", None, None)],
    ]
    got = streams(schema, lambda s: processors.job_stream(s, "k", "ts", "n", ttl=100), arrivals)
    assert got[0] == [("a", "running", "fetch", "p", None, 2), ("b", "pending", None, None, None, 3)]
    assert got[1] == [("a", "done", "last", "p", None, 4)]
    every = sorted(got[2] + got[3], key=str)
    assert every == sorted([("c", "running", None, None, None, 7), ("a", "expired", None, None, None, 4), ("b", "expired", None, None, None, 3), ("c", "running", "second", None, None, 8)], key=str)


def test_signs_of_life(streams):
    got = streams("k long, ts timestamp, n long", lambda s: processors.keepalive_stream(s, "k", "ts", "n", 3.0), [[(1, at(0), 1), (1, at(3), 2)], [(1, at(10), 3), (2, at(50), 4)]])
    assert [r[1:] for rows in got for r in sorted(rows, key=lambda r: r[1])] == [(1, 0), (2, 0), (3, 2), (4, 0)]
