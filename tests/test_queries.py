"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from dwell.plans.oracles import ORACLES
from dwell.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rounded(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    r = duck.execute(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(d[0] for d in r.description)
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted((tuple(rounded(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert sorted((tuple(rounded(x[c]) for c in cols) for x in got.collect()), key=repr) == want


def test_every_operator_query_has_a_schema(spark):
    for f in QUERIES.values():
        assert f(spark, DIR).columns
