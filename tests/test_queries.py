"""Every registered query against its SQL on the smallest tables, as the driver compares them."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from marginalia import plans


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    ran = duck.execute(plans.SQL[name])
    columns = sorted(d[0] for d in ran.description)
    assert columns == sorted(df.columns)
    at = [[d[0] for d in ran.description].index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in ran.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "state", "n", "share"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
