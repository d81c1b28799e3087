"""Every query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from palisade.plans import catalog
from palisade.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    cur = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(norm(r[c]) for c in order) for r in got), key=key)
    b = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert a == b
