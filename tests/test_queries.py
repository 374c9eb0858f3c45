"""Every query with SQL against that SQL on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from memspark.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, columns, values):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.columns, columns, df.collect())
    if name in ORACLES:
        r = oracle.execute(ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == rows(names, columns, r.fetchall())
