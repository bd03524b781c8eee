import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("fathomline.llm")

from fathomline.llm.split import cuts, split_oversized  # noqa: E402


def text_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.randint(3, 14))).capitalize() + rng.choice([". ", ". ", "! ", ".\n\n"]))
    return "".join(out)


def check(text, parts, limit=1400, overlap=100):
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert c <= b < d and b - c <= overlap and c > a
    assert all(b - a <= limit for a, b in parts)
    whole = text[: parts[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(parts, parts[1:]))
    assert whole == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 .!\n ßé"), min_size=0, max_size=6000))
def test_pieces_cover_any_text(text):
    check(text, cuts(text))


def test_ends_are_natural_where_there_are_any():
    text = text_of(20_000)
    for _, end in cuts(text)[:-1]:
        assert text[end - 1] in ".!" and text[end].isspace()
    words = "wort " * 2000
    assert all(words[end - 1] == "t" and words[end] == " " for _, end in cuts(words)[:-1])


def test_no_boundary_at_all():
    for text in ("7" * 9000, "".join(random.Random(1).choices("abcdef", k=9000))):
        parts = cuts(text)
        check(text, parts)
        assert all(p[1] - q[0] == 100 for p, q in zip(parts, parts[1:]))


def test_an_edit_alters_neighbouring_pieces_only():
    text = text_of(60_000)
    edited = text[:20_000] + "Ein neuer Satz steht hier. " + text[20_000:]
    old, new = ({t[a:b] for a, b in cuts(t)} for t in (text, edited))
    assert len(old - new) <= 3 and len(new - old) <= 3


def test_every_piece_has_text_of_its_own():
    for seed in range(60):
        parts = cuts(text_of(1401 + 97 * seed, seed))
        assert all(d - b >= 350 for (_, b), (_, d) in zip(parts, parts[1:]))


def test_rows(spark):
    data = [(1, None, 3), (2, "", 3), (3, "x" * 1400, 3), (4, text_of(3000), 3), (5, text_of(3000), None), (5, text_of(5000, 1), 0)]
    df = spark.createDataFrame([(*d, "z") for d in data], "row_id bigint, text string, seq int, piece string")
    out = split_oversized(df, "row_id", F.col("text"), F.col("seq")).collect()
    assert {r.id for r in out} == {4, 5}
    four = sorted((r for r in out if r.id == 4), key=lambda r: r.piece)
    assert [r.seq for r in four] == list(range(3, 3 + len(four))) and all(len(r.text) <= 1400 for r in four)
    assert four[0].text == data[3][1][four[0].start : four[0].end]
    assert split_oversized(df.where("false"), "row_id", F.col("text"), F.col("seq")).count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x", 0)], "row_id bigint, text string, seq int")
    plan = split_oversized(df, "row_id", F.col("text"), F.col("seq"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
