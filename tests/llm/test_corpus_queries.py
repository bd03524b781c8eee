"""Registered queries against their SQL on the smallest data."""

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm.queries import ORACLE, QUERIES  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = QUERIES[name](spark, str(FOLDER))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
