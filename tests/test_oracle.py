"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from wordmine.oracles import all_oracles
from wordmine.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    result = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    assert got == sorted(result.fetchall(), key=repr)
    assert len(result.description) == len(cols)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["word", "freq", "cohesion", "freedom"]
    assert out.count() > 0
