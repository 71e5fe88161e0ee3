"""Every query with SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sievery import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "" if value is None else f"{value:.9g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([[plain(r[i]) for i in order] for r in rows])


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    said = db.execute(plans.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, said.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)
