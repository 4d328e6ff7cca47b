"""Every query with SQL equals it on the smallest tables; the others run."""

import datetime
import decimal

import duckdb
import pytest
from conftest import DATA

from newsloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources batches items articles mix_targets containers person_names".split()


def same(v):
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 4)
    return tuple(map(same, v)) if isinstance(v, list | tuple) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(same(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda x: tuple((v is None, str(v)) for v in x))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in catalog.SQL:
        r = duck.execute(catalog.SQL[name])
        columns = [x[0] for x in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, r.fetchall())


def test_flagship():
    assert catalog.FLAGSHIP in catalog.QUERIES and not isinstance(datetime.date.today(), str)
