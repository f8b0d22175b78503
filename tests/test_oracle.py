"""Every registered query against its SQL on the same tables, as sorted rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from chiffra.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else tuple(fix(x) for x in v) if isinstance(v, list) else v
    return [columns[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in data), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert got[1]
        return
    cur = con.execute(ORACLE_SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
