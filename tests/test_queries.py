"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from byteloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def other(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    x = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(map(tuple, x.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, other, name):
    a, b = QUERIES[name](spark, sf).toPandas(), other.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_crc(spark, sf):
    import zlib

    d = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(zlib.crc32(d[r.doc_id].encode()) == r.crc for r in QUERIES["crc_check"](spark, sf).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
