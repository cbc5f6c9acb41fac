"""Every registered query on the small tables, against its SQL where there is some."""

import datetime as dt
import math

import duckdb
import pytest

from quillgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool | str | dt.datetime):
        return str(value)
    return repr(round(float(value), 5)) if isinstance(value, int | float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.SQL:
        rel = duck.sql(catalog.SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        columns = sorted(df.columns)
        want = sorted([plain(row[rel.columns.index(c)]) for c in columns] for row in rel.fetchall())
        assert sorted([plain(r[c]) for c in columns] for r in got) == want


def test_sql_belongs_to_queries():
    assert catalog.SQL.keys() <= catalog.QUERIES.keys()
