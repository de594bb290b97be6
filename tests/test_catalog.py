"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sheafline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    told = duck.execute(catalog.ORACLES[name])
    at = [[d[0] for d in told.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
