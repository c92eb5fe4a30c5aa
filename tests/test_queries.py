"""Every query of the fund-flow library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from ledgertide.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if value != value else f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return None if value is None else str(value)


def rows_of(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    found = catalogue.queries()[name](spark, SF)
    wanted = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, wanted.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
