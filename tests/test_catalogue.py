"""Every registered query with an oracle gives the rows of its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from siltstone.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(str([plain(v) for v in r]) for r in df.select(columns).collect())
    if name not in ORACLES:
        assert rows
        return
    rel = duck.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    ref = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert rows == ref
