"""Every named query against its SQL on the smallest tables, and on empty ones."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CORE = {k: f for m in entry._modules() if not m.__name__.startswith("quire.llm") for k, f in m.QUERIES.items()}
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return tuple(map(plain, v.asDict().values() if hasattr(v, "asDict") else v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    return c


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("empty")
    for t in os.listdir(FOLDER):
        pq.write_table(pq.read_table(f"{FOLDER}/{t}").slice(0, 0), folder / t)
    return str(folder)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    rows = df.collect()
    if name in SQL:
        duck.execute(SQL[name])
        columns = [d[0] for d in duck.description]
        assert sorted(columns) == sorted(df.columns)
        assert table(df.columns, rows) == table(columns, duck.fetchall())


@pytest.mark.parametrize("name", sorted(CORE))
def test_empty(spark, empty, name):
    CORE[name](spark, empty).collect()
