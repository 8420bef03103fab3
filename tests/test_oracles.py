"""Every query with an oracle gives the same rows as DuckDB."""

import duckdb
import pytest

from weftlink.plans import tasks
from weftlink.plans.queries import ORACLES, QUERIES

TABLES = "documents benchmark customer orders nation region part".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def task(spark, sf):
    return tasks.Task(spark, sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, task, name, monkeypatch):
    monkeypatch.setattr(tasks, "Task", lambda *_: task)  # records, candidates and pairs are written once for all queries
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    want = sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()))
    assert got == want
