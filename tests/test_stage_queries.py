"""Each stage query against its SQL on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from claimforge import queries, stage_queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == stage_queries.__name__]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    told = con.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(told.description)}
    assert sorted(at) == names
    show = lambda row: tuple("-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(show(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == sorted(show([r[at[n]] for n in names]) for r in told.fetchall())
