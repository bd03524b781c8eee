"""Registered queries against their SQL on the smallest data, and the driver's contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fathomline.queries.registry import ORACLE, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(FOLDER))
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    if name in ORACLE:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert got == sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()), key=repr)
    else:
        assert got or name == "positional_pairing"  # no page has three labels and amounts there


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
