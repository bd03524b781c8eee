import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("fathomline.llm")

from fathomline.llm import leaks  # noqa: E402


def distance(p, t):
    """Brute force: the least edit distance of p to any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=70), st.lists(st.sampled_from("abc"), max_size=40))
def test_bit_parallel_distance(p, t):
    assert leaks.least_distance(p, t) == distance(p, t)


def words(n, seed, vocabulary=60):
    rng = random.Random(seed)
    return ["w" + "abcdefghij"[rng.randrange(10)] + "klmnop"[rng.randrange(6)] for _ in range(n)]


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_finder_against_brute_force(budget):
    rng = random.Random(budget)
    items = [(i, words(40, i)) for i in range(6)]
    finder = leaks.Finder(items, 12, budget)
    for case in range(60):
        own = items[case % 6][1]
        a = rng.randrange(0, 25)
        part = own[a : a + rng.choice([10, 11, 12, 13, 15])]
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        text = words(30, 1000 + case) + part + words(30, 2000 + case)
        got = finder.find(" ".join(text))
        for item, ws in items:
            want = min(distance(ws[s : s + 12], text) for s in range(len(ws) - 11))
            assert (item in got) == (want <= budget), (case, item)
            if item in got:
                run = max((n for s in range(len(ws)) for n in range(1, len(ws) - s + 1) if any(text[k : k + n] == ws[s : s + n] for k in range(len(text)))), default=0)
                assert (got[item][1] >= 12) == (run >= 12)


ITEM = "Der Zuschlag Sazota97 wurde notiert; die Größe war 17 Prozent, der Revisor kürzte 12 weitere Blätter heute früh."


def test_rows(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "zu kurz", "x"), (3, None, "x"), (4, ITEM, "x"), (None, ITEM, "x")], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame(
        [(1, "Vorher. " + ITEM.upper() + " Nachher.", 1), (2, ITEM.replace("Größe", "GRÖSSE - "), 1), (3, " ".join(ITEM.split()[:9]), 1), (4, None, 1), (5, "", 1), (6, "nichts davon " * 50_000, 1), (1, ITEM, 1)],
        "doc_id bigint, text string, item_id int",
    )
    got = leaks.find_leaks(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"))
    assert sorted((r.doc_id, r.item_id) for r in got.where("run >= 12").collect()) == [(1, 1), (1, 1), (1, 4), (1, 4), (2, 1), (2, 4)]
    assert sorted((r.doc_id, r.item_id) for r in got.where("distance = 0 and words = 12").collect()) == [(1, 1), (1, 1), (1, 4), (1, 4), (2, 1), (2, 4)]
    short = spark.createDataFrame([(8, "Das ist ZU  kurz!", 1), (9, "das ist nicht zu kurz", 1)], "doc_id bigint, text string, item_id int")
    assert [tuple(r) for r in leaks.find_leaks(short, "doc_id", F.col("text"), items, "item_id", F.col("text")).collect()] == [(8, 2, 0, 2, 2), (9, 2, 0, 2, 2)]
    assert leaks.find_leaks(short.select("doc_id", F.lit("zu wenig kurz").alias("text")), "doc_id", F.col("text"), items, "item_id", F.col("text")).count() == 0
    assert leaks.find_leaks(docs, "doc_id", F.col("text"), items.where("false"), "item_id", F.col("text")).count() == 0
    assert leaks.find_leaks(docs.where("false"), "doc_id", F.col("text"), items, "item_id", F.col("text")).count() == 0


def test_many_items_in_several_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(words(30, i))) for i in range(9)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(words(30, i))) for i in range(9)], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 2)
    got = leaks.find_leaks(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"))
    assert {(r.doc_id, r.item_id) for r in got.where("run >= 12").collect()} == {(i, i) for i in range(9)}
