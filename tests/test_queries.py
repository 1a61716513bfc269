"""Every registered query of the core catalogue against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from civilake.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(value):
    """One form for values of both engines."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return tuple(plain(v) for v in value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    rows = found.collect()
    if name not in catalogue.ORACLES:
        assert all(len(row) == len(found.columns) for row in rows)
        return
    wanted = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, rows) == rows_of(wanted.columns, wanted.fetchall())
