import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import chunk, dense, evaluate, fuse, lexical
from fathomline.plans.search import search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_tokenizers(spark):
    assert one(spark, "Straße CAFÉ b2 abc123 x 12,5", T.tokens) == ["strasse", "café", "2", "abc", "123", "12", "5"]
    assert one(spark, "café", lambda c: T.tokens(c, "evaluator")) == ["caf"]
    assert one(spark, None, T.tokens) == []


def test_numbers(spark):
    assert one(spark, "a1.234,56 EUR", T.digits) == "123456" and one(spark, None, T.digits) == ""
    assert [one(spark, x, T.is_money) for x in ("1.234,56", "12345,67", "123456,78", "12,5", None)] == [True, True, False, False, False]
    assert sorted(one(spark, "12.0", T.number_variants)) == ["12", "12,0", "12.0"] and one(spark, "", T.number_variants) == []
    has = lambda text, v: one(spark, text, lambda c: T.text_has(c, F.array(F.lit(v)), F.lit(True)))
    assert has("size 12,5", "12") and not has("112", "12") and not has("3,12", "12") and not has("123", "12")
    assert one(spark, "13585;13", T.repaired) == "13585,13" and one(spark, "37315 | 69", T.repaired) == "37315,69" and one(spark, "28.121.23", T.repaired) == "28.121,23" and one(spark, "43.296,32 €", T.repaired) == "43.296,32"
    assert one(spark, "3. Brutto", T.row_label) == 3 and one(spark, "Brutto", T.row_label) is None
    assert one(spark, "Zahl der Arbeitstage", T.telling_word) == "Arbeitstage" and one(spark, "ab", T.telling_word) == "ab"


def test_bm25_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, "gamma delta")], "id bigint, text string")
    asked = lexical.query_terms(spark.createDataFrame([(7, "Beta alpha alpha zeta"), (8, "zeta"), (9, None)], "q_id bigint, q string"), "q_id", F.col("q"))
    got = {(r.q_id, r.id): r.score for r in lexical.bm25(docs, "id", F.col("text"), asked).collect()}
    n, mean = 4, 6 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda df, tf, size: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
    assert got == {(7, 1): round(part(2, 1, 3) + part(1, 2, 3), 6), (7, 2): round(part(2, 1, 1), 6)}
    assert lexical.bm25(docs.where("false"), "id", F.col("text"), asked).count() == 0


def test_many_terms_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"wort{'abc'[i % 3]} immer") for i in range(30)], "id bigint, text string")
    asked = lexical.query_terms(spark.createDataFrame([(1, "worta immer"), (2, "wortb")], "q_id bigint, q string"), "q_id", F.col("q"))
    want = sorted(map(tuple, lexical.bm25(docs, "id", F.col("text"), asked).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, lexical.bm25(docs, "id", F.col("text"), asked).collect())) == want


def test_rankings(spark):
    s = spark.createDataFrame([(1, 5, 1.0), (1, 4, 1.0), (1, 9, 2.0)], "q_id int, id bigint, score double")
    assert [r.id for r in lexical.top(s, 2).orderBy("rk").collect()] == [9, 4]
    docs, queries = spark.range(6).withColumnRenamed("id", "d"), spark.createDataFrame([(1,), (2,)], "q int")
    got = lexical.evaluator_top(s, docs, "d", queries, "q", 4).orderBy("q_id", "rk").collect()
    assert [(r.q_id, r.id) for r in got] == [(1, 9), (1, 4), (1, 5), (1, 0), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_fusion_ties_and_merge(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q_id int, id bigint, rk int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2), (1, 30, 3)], "q_id int, id bigint, rk int")
    assert [r.id for r in fuse.fused(a, b, 3).orderBy("rk").collect()] == [10, 20, 30]
    ranked = spark.createDataFrame([(1, c, i, r, s) for c, i, r, s in (("a", 1, 1, 0.1), ("a", 2, 2, 0.05), ("b", 3, 1, 9.0))], "q_id int, container_id string, id int, rk int, score double")
    assert [r.id for r in fuse.merged(ranked, 2).orderBy("rk").collect()] == [3, 1]
    assert [r.id for r in fuse.merged(ranked, 2, by_cosine=True).orderBy("rk").collect()] == [1, 2]
    picks = spark.createDataFrame([(1, 30, 0), (1, 30, 1), (1, 99, 2), (1, 20, 3)], "q_id int, id bigint, pick int")
    assert [r.id for r in fuse.promoted(b, picks).orderBy("new_rk").collect()] == [30, 20, 10]


def test_exact_search_and_search_plan(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id bigint, embedding array<float>")
    units = dense.with_units(v, "id", F.col("embedding"), 2)
    got = dense.exact_nearest(units, units.where("id = 1"), 2, 5).orderBy("rk").collect()
    assert [(r.id, r.score) for r in got] == [(3, 0.707107), (2, 0.0)]
    chunks = spark.createDataFrame([(1, "alpha beta", "s1"), (2, "beta", "s2"), (3, "gamma", "s3")], "id bigint, text string, source string")
    q = spark.createDataFrame([(0, "beta"), (1, "nichts")], "q_id bigint, q string")
    assert [(r.q_id, r.id, r.mode) for r in search(chunks, q, 0).orderBy("rk").collect()] == [(0, 2, "lexical"), (0, 1, "lexical")]
    qv = spark.createDataFrame([(0, [1.0, 0.1])], "id bigint, embedding array<float>")
    got = search(chunks, q, 3, v.where("id < 4"), qv, 2).orderBy("rk").collect()
    assert [(r.q_id, r.id, r.mode) for r in got][:2] == [(0, 1, "hybrid"), (0, 2, "hybrid")]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "D-1", "12"), (2, "D-2", ""), (3, "D-3", "7")], "q_id int, doc string, value string")
    ranked = spark.createDataFrame([(1, 1, 2, "x/D-1.pdf", "a 1 b 2"), (2, 1, 1, "D-2", "5"), (3, 2, 1, "D-9", "7")], "q_id int, id int, rk int, source string, text string")
    chunks = spark.createDataFrame([("in/D-3.md", "wert 7", 1), ("D-1", "9", 1)], "source string, text string, q_id int")
    got = {r.q_id: r for r in evaluate.per_question(evaluate.with_hits(ranked, gold), gold, evaluate.answerable(gold, chunks)).collect()}
    assert (got[1].hit1, got[1].hit3, got[1].diagnosis) == (0, 1, None)
    assert got[2].diagnosis == "no atom" and got[3].diagnosis == "rank > 3"


def test_chunkers(spark):
    doc = lambda t: spark.createDataFrame([(1, t, None)], "id bigint, text string, p string")
    got = chunk.paragraphs(doc("x" * 20 + "\n \n" + "y" * 21 + "\nz\n\n\n"), "id", F.col("text")).collect()
    assert [(r.line_from, r.line_to, r.text) for r in got] == [(3, 4, "y" * 21 + "\nz")]
    blocks = F.array(F.lit("a" * 500), F.lit("b" * 500), F.lit("c" * 100))
    assert [(r.seq, len(r.text)) for r in chunk.greedy(doc(""), "id", blocks).collect()] == [(0, 1002)]
    assert [(r.start, len(r.text)) for r in chunk.char_windows(doc("x" * 470), "id", F.col("text")).collect()] == [(0, 470), (460, 10)]
    got = chunk.word_windows(doc(" ".join(["wort"] * 200)), "id", F.col("text"), F.col("p")).collect()
    assert all(len(r.text) <= 480 for r in got) and sum(r.text.count("wort") for r in got) == 200
    rows = spark.createDataFrame([(2, "s", "t"), (1, "s", "t"), (3, "a", "u"), (4, None, None)], "id bigint, source string, text string")
    assert sorted(r.id for r in chunk.first_by_content(rows, "text", ["source", "id"]).collect()) == [1, 3, 4]
    for f in (lambda d: chunk.paragraphs(d, "id", F.col("text")), lambda d: chunk.char_windows(d, "id", F.col("text")), lambda d: chunk.word_windows(d, "id", F.col("text"), F.col("p"))):
        assert f(doc(None)).count() == 0


@pytest.mark.parametrize("seeds", [1, 64])
def test_best_documents_in_blocks_and_by_joins(spark, rows, monkeypatch, seeds):
    """Both plans give the k best of all scored pairs, with ties, empty texts and many blocks."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"wort{chr(97 + i)}" for i in range(20)] + ["der", "die"])
    weights = np.r_[np.full(20, 0.5), 10, 10]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 12), p=weights / weights.sum())) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(900, None, 1, 2), (901, "", 1, 2), (902, texts[0], 1, 2)], "id bigint, text string, len int, q_id int")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary, 4))) for i in range(40)] + [(50, None), (51, "fehlt")], "q_id bigint, q string")
    terms = lexical.query_terms(asked, "q_id", F.col("q"))
    want = rows(lexical.top(lexical.bm25(docs, "id", F.col("text"), terms), 7).select("q_id", "id", "score", "rk"))
    assert rows(lexical._top_by_joins(docs, "id", F.col("text"), terms, 7, "server", seeds).select("q_id", "id", "score", "rk")) == want
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(lexical, "BLOCK", 90)
    assert rows(lexical.bm25_top(docs, "id", F.col("text"), terms, 7).select("q_id", "id", "score", "rk")) == want
    names = docs.withColumn("id", F.format_string("d%04d", "id"))
    got = lexical.bm25_top(names, "id", F.col("text"), terms, 7)
    assert rows(got.select("q_id", F.substring("id", 2, 9).cast("long").alias("id"), "score", "rk")) == want
    assert lexical.bm25_top(docs.where("false"), "id", F.col("text"), terms, 7).count() == 0 == lexical.bm25_top(docs, "id", F.col("text"), terms.where("false"), 7).count()


@pytest.mark.parametrize("share", [0.0, 0.01, 2.0])
def test_many_queries_and_parts_in_blocks(spark, rows, monkeypatch, share):
    """Queries beyond the broadcast bound, whose terms are few, meet documents in blocks, all terms by a product, by
    single hits or by both; and the best of each part are those of all scored pairs."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"wort{chr(97 + i)}" for i in range(20)] + ["der", "die"])
    weights = np.r_[np.full(20, 0.5), 10, 10]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 12), p=weights / weights.sum())) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, f"p{i % 7}" if i % 11 else None) for i, t in enumerate(texts)] + [(900, "fremd", "a"), (901, None, "b")], "id bigint, text string, part string")
    terms = lexical.query_terms(spark.createDataFrame([(i, " ".join(rng.choice(vocabulary, 4))) for i in range(40)] + [(50, None)], "q_id bigint, q string"), "q_id", F.col("q"))
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 1_500)
    monkeypatch.setattr(lexical, "_top_by_joins", None)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(lexical, "BLOCK", 200)
    monkeypatch.setattr(lexical, "DENSE_SHARE", share)
    monkeypatch.setattr(lexical, "MANY_PAIRS", 0.0 if share == 2.0 else 2.0)
    monkeypatch.setattr(lexical, "HITS_AT_ONCE", 3 if share == 0.01 else 2_000)
    scored = lexical.bm25(docs, "id", F.col("text"), terms)
    got = lexical.bm25_top(docs, "id", F.col("text"), terms, 7)
    assert rows(got) == rows(lexical.top(scored, 7).select("q_id", "id", "score", "rk"))
    held = scored.join(docs.select("id", "part"), "id").where("part is not null and part < 'p4'").withColumn("by", F.struct("q_id", "part"))
    want = rows(lexical.top(held, 3, by="by").select("q_id", "part", "id", "score", "rk"))
    assert rows(lexical.bm25_top_by_part(docs, "id", F.col("text"), terms, 3, "part", 4)) == want
    monkeypatch.setattr(lexical, "ASKED_PAIRS", 1)
    assert rows(lexical.bm25_top_by_part(docs, "id", F.col("text"), terms, 3, "part", 4)) == want
