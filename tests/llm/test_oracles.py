from __future__ import annotations

import duckdb
import pytest

from wordmine.llm.oracles import all_oracles
from wordmine.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = all_queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    expected = con.execute(f"SELECT {', '.join(cols)} FROM ({all_oracles()[name]})").fetchall()
    assert got == sorted(expected, key=repr)
    con.close()
