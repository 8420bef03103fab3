"""Queries of this package against their SQL."""

import duckdb
import pytest

from weftlink.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()))
