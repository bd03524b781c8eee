"""Registered queries do the whole job: no row, text or job is left out."""

from pathlib import Path

import duckdb
import pytest

from fathomline.queries.registry import ORACLE, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_context_blocks_hold_whole_passages(spark, con):
    blocks = {r.q_id: r for r in QUERIES["context_block"](spark, str(FOLDER)).collect()}
    hits = con.execute(f"SELECT q_id, text FROM ({ORACLE['bm25_topk']}) r JOIN chunks USING (row_id) WHERE rk <= 3").fetchall()
    assert any(len(text) > 200 for _, text in hits)
    assert all(text in blocks[q].block for q, text in hits)
    assert sum(b.passages for b in blocks.values()) == len(hits)


def test_job_states_of_all_jobs(spark, con):
    rows = con.execute("SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) % 4 FROM events ORDER BY ts, event_id").fetchall()
    latest, want = {}, {}
    for event, _, user, kind, k in rows:
        if kind == "click":
            latest[user], want[event] = event, ("queued", "running", "sealed", "failed")[k]
        elif kind in ("view", "signup", "error") and user in latest:
            now, new = want[latest[user]], {"view": "running", "signup": "sealed", "error": "failed"}[kind]
            if (now, new) in (("queued", "running"), ("running", "sealed"), ("running", "failed")):
                want[latest[user]] = new
    assert {r.id: r.status for r in QUERIES["job_states"](spark, str(FOLDER)).collect()} == want


def test_long_words_are_corrected(spark):
    from fathomline.operators import lexicon

    a, b = "x" * 42, "y" * 60
    known = spark.createDataFrame([(w,) for w in (a, a + "abc", b, "cat")], "word string")
    asked = spark.createDataFrame([(w,) for w in (a + "ab", a + "abcde", b[:-2], b + "yyy", "y" * 5000, a + "a", "catt")], "word string")
    got = {r.word: (r.corrected, r.distance) for r in lexicon.corrected(asked, known).collect()}
    assert got == {a + "ab": (a + "abc", 1), a + "abcde": (a + "abc", 2), b[:-2]: (b, 2), b + "yyy": (b + "yyy", None), "y" * 5000: ("y" * 5000, None), a + "a": (a, 1), "catt": ("cat", 1)}
