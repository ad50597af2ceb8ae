"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidelog.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    order = sorted(frame.columns)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == order
    rows = lambda tuples, names: sorted(tuple(plain(dict(zip(names, t, strict=True))[c]) for c in order) for t in tuples)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(expected.fetchall(), expected.columns)


def test_catalogue_entries(spark, sf_dir):
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
    assert catalogue.flagship(spark, sf_dir).count() == 3
