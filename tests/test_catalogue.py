import json
import math
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from vocabra.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(v) for v in r)) for r in want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)
    json.dumps(catalogue.ORACLE)
