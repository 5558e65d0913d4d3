"""Every registered query of the ledger part against its SQL on DuckDB."""

import decimal
import math

import duckdb
import pytest

from ledgerloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("str_",)


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in plans.ORACLE if not n.startswith(SLOW)])
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    cur = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_every_query_has_its_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)
