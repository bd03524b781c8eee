"""Queries: tokens, BM25, dense search, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import digits, tokens
from fathomline.operators import dense, evaluate, fuse, lexical
from fathomline.session import materialize, table

DIMS = 64


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.size(tokens("text")).cast("long").alias("n_server"), F.size(tokens("text", "evaluator")).cast("long").alias("n_evaluator"))


def term_df(spark: SparkSession, folder: str) -> DataFrame:
    t = lexical.term_table(table(spark, folder, "documents"), "doc_id", F.col("text")).where("token <> ''")
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def doc_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size(tokens("text")).cast("long")
    return table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_len"))


def _gold_top(spark: SparkSession, folder: str, k: int, mode: str = "server") -> DataFrame:
    asked = lexical.query_terms(table(spark, folder, "gold"), "q_id", F.col("q"), mode)
    return lexical.bm25_top(table(spark, folder, "chunks"), "row_id", F.col("text"), asked, k, mode)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _gold_top(spark, folder, 10).withColumnRenamed("id", "row_id")


def bm25_topk_evalrank(spark: SparkSession, folder: str) -> DataFrame:
    best = _gold_top(spark, folder, 50, "evaluator").drop("rk")
    return lexical.evaluator_top(best, table(spark, folder, "chunks"), "row_id", table(spark, folder, "gold"), "q_id").withColumnRenamed("id", "row_id")


def _doc_rankings(spark: SparkSession, folder: str, k: int, mode: str = "server") -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    units = dense.with_units(table(spark, folder, "embeddings"), "vec_id", F.col("embedding"), DIMS)
    queries = docs.where("doc_id % 20 = 0")
    lex = lexical.bm25_top(docs, "doc_id", F.col("text"), lexical.query_terms(queries, "doc_id", F.col("text"), mode), k, mode)
    near = dense.exact_nearest(units, units.where("id % 20 = 0"), DIMS, k)
    return near, lex


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    units = dense.with_units(table(spark, folder, "embeddings"), "vec_id", F.col("embedding"), DIMS)
    return dense.exact_nearest(units, units.where("id % 20 = 0"), DIMS, 10)


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    near, lex = _doc_rankings(spark, folder, 100)
    return fuse.fused(near, lex, 8).select("q_id", "id", "score", "rk")


def rrf_eval50(spark: SparkSession, folder: str) -> DataFrame:
    """As the evaluation ranks: its own tokens, the first 50 of either side, documents of score 0 among them."""
    near, lex = _doc_rankings(spark, folder, 50, "evaluator")
    docs = table(spark, folder, "documents")
    lex = lexical.evaluator_top(lex.drop("rk"), docs, "doc_id", docs.where("doc_id % 20 = 0"), "doc_id")
    return fuse.fused(near, lex, 10).select("q_id", "id", "score", "rk")


def _by_container(spark: SparkSession, folder: str) -> DataFrame:
    asked = lexical.query_terms(table(spark, folder, "gold"), "q_id", F.col("q"))
    best = lexical.bm25_top_by_part(table(spark, folder, "chunks"), "row_id", F.col("text"), asked, 8, "container_id", 20)
    return materialize(best.withColumnRenamed("part", "container_id"))


def fanout_merge(spark: SparkSession, folder: str) -> DataFrame:
    return fuse.merged(_by_container(spark, folder), 8)


def fanout_merge_by_container(spark: SparkSession, folder: str) -> DataFrame:
    return fuse.merged(_by_container(spark, folder), 8, by_cosine=True)


def _top_with_text(spark: SparkSession, folder: str, k: int) -> DataFrame:
    ranked = _gold_top(spark, folder, k, "evaluator")
    return ranked.join(table(spark, folder, "chunks").select(F.col("row_id").alias("id"), "source", "text"), "id")


def rerank_promote(spark: SparkSession, folder: str) -> DataFrame:
    """The picks, which a model would make, are the results that hold the gold value's digits, last first."""
    ranked = _top_with_text(spark, folder, 10)
    wanted = table(spark, folder, "gold").select("q_id", digits("value").alias("wanted"))
    picks = ranked.join(wanted, "q_id").where("wanted <> ''").where(F.contains(digits("text"), F.col("wanted"))).select("q_id", "id", (-F.col("rk")).alias("pick"))
    return fuse.promoted(ranked.select("q_id", "id", "rk"), picks)


def rerank_candidates(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.col("row_id").alias("id"), "source", "text")
    return fuse.candidate_lists(_gold_top(spark, folder, 20), chunks)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    gold = table(spark, folder, "gold")
    hits = evaluate.with_hits(_top_with_text(spark, folder, 3), gold)
    return evaluate.per_question(hits, gold, evaluate.answerable(gold, table(spark, folder, "chunks")))


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.report(_questions(spark, folder)).select("questions", *(F.round(c, 6).alias(c) for c in ("recall1", "recall3", "oracle")))


def fail_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).where("diagnosis is not null").select("q_id", "diagnosis", F.array_join("sources", "; ").alias("sources"))


def match_projection(spark: SparkSession, folder: str) -> DataFrame:
    """What a search returns: the score to 4 digits, the text's first 700 characters, and provenance."""
    ranked = _gold_top(spark, folder, 8)
    chunks = table(spark, folder, "chunks").select(F.col("row_id").alias("id"), "source", F.substring("text", 1, 700).alias("text"), "page", "y", "line_from", "line_to", "reader")
    return ranked.join(chunks, "id").select("q_id", "rk", F.round("score", 4).alias("score"), F.col("id").alias("row_id"), "source", "text", "page", "y", "line_from", "line_to", "reader")


QUERIES = {f.__name__: f for f in (
    tokenize_counts, term_df, doc_length_stats, bm25_topk, bm25_topk_evalrank, dense_topk, rrf_fuse, rrf_eval50, fanout_merge,
    fanout_merge_by_container, rerank_promote, rerank_candidates, recall_at_k, fail_diagnosis, match_projection,
)}

_SERVER, _EVAL = "[a-zà-ÿ]{2,}|[0-9]+", "[a-zäöü]{2,}|[0-9]+"


def _tok(text: str, pattern: str = _SERVER) -> str:
    return f"regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '{pattern}')"


def _scores(docs: str, id_: str, queries: str, q_id: str, q: str, pattern: str = _SERVER) -> str:
    return f"""d AS (SELECT {id_} AS id, {_tok('text', pattern)} AS w FROM {docs}),
stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS token FROM d) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT {q_id} AS q_id, unnest(list_distinct({_tok(q, pattern)})) AS token FROM {queries}),
s AS (SELECT q_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM qt JOIN df USING (token) JOIN tf USING (token) CROSS JOIN stat GROUP BY 1, 2)"""


_GOLD = _scores("chunks", "row_id", "gold", "q_id", "q")
_GOLD_EVAL = _scores("chunks", "row_id", "gold", "q_id", "q", _EVAL)
_RANK = "row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)"
_DENSE = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS q_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0)"""
_FUSED = """, lx AS (SELECT * FROM (SELECT *, RANK_ AS rk FROM LEX_) WHERE rk <= LIMIT_), dn AS (SELECT * FROM (SELECT *, RANK_ AS rk FROM near) WHERE rk <= LIMIT_),
f AS (SELECT coalesce(d.q_id, l.q_id) AS q_id, coalesce(d.id, l.id) AS id, d.rk AS dr, l.rk AS lr,
  round(coalesce(1.0 / (60 + d.rk), 0) + coalesce(1.0 / (60 + l.rk), 0), 8) AS score FROM dn d FULL JOIN lx l ON d.q_id = l.q_id AND d.id = l.id)
SELECT q_id, id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, dr NULLS LAST, lr) AS rk FROM f) WHERE rk <= TOP_""".replace("RANK_", _RANK)
_ASKING = "(SELECT * FROM documents WHERE doc_id % 20 = 0)"
_ZERO = f""", z AS (SELECT * FROM s UNION ALL SELECT a.doc_id, x.doc_id, 0.0 FROM {_ASKING} a, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.q_id = a.doc_id AND s.id = x.doc_id))"""
_PER_CONTAINER = f"WITH {_GOLD}, c AS (SELECT s.*, chunks.container_id, row_number() OVER (PARTITION BY q_id, chunks.container_id ORDER BY score DESC, s.id) AS crk FROM s JOIN chunks ON s.id = row_id), first AS (SELECT DISTINCT container_id FROM c ORDER BY 1 LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ORDER_) AS rk FROM c JOIN first USING (container_id) WHERE crk <= 8) SELECT q_id, container_id, id, score, rk FROM r WHERE rk <= 8"
_TOP_TEXT = f"WITH {_GOLD_EVAL}, r AS (SELECT * FROM (SELECT *, {_RANK} AS rk FROM s) WHERE rk <= TOP_), t AS (SELECT r.*, source, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS d FROM r JOIN chunks ON r.id = row_id), g AS (SELECT *, regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g') AS wanted FROM gold)"
_QUESTIONS = _TOP_TEXT.replace("TOP_", "3") + """, h AS (SELECT t.q_id, rk FROM t JOIN g USING (q_id) WHERE contains(source, doc) AND wanted <> '' AND contains(d, wanted)),
o AS (SELECT DISTINCT q_id FROM g JOIN chunks c ON contains(c.source, g.doc) AND contains(regexp_replace(coalesce(c.text, ''), '[^0-9]', '', 'g'), wanted) WHERE wanted <> ''),
a AS (SELECT q_id, CAST(q_id IN (SELECT q_id FROM h WHERE rk = 1) AS INT) AS hit1, CAST(q_id IN (SELECT q_id FROM h) AS INT) AS hit3, CAST(q_id IN (SELECT q_id FROM o) AS INT) AS oracle FROM gold)"""

ORACLE = {
    "tokenize_counts": f"SELECT doc_id, len({_tok('text')}) AS n_server, len({_tok('text', _EVAL)}) AS n_evaluator FROM documents",
    "term_df": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tok('text')}) AS token FROM documents) GROUP BY 1",
    "doc_length_stats": f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_len FROM (SELECT len({_tok('text')}) AS n FROM documents)",
    "bm25_topk": f"WITH {_GOLD} SELECT q_id, id AS row_id, score, rk FROM (SELECT *, {_RANK} AS rk FROM s) WHERE rk <= 10",
    "bm25_topk_evalrank": f"WITH {_GOLD_EVAL}, z AS (SELECT * FROM s UNION ALL SELECT q_id, row_id, 0.0 FROM gold, (SELECT row_id FROM chunks ORDER BY row_id LIMIT 50) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.q_id = gold.q_id AND s.id = x.row_id)) SELECT q_id, id AS row_id, score, rk FROM (SELECT *, {_RANK} AS rk FROM z) WHERE rk <= 50",
    "dense_topk": f"WITH {_DENSE} SELECT q_id, id, rk, score FROM (SELECT *, {_RANK} AS rk FROM near) WHERE rk <= 10",
    "rrf_fuse": f"WITH {_scores('documents', 'doc_id', _ASKING, 'doc_id', 'text')}, {_DENSE}" + _FUSED.replace("LEX_", "s").replace("LIMIT_", "100").replace("TOP_", "8"),
    "rrf_eval50": f"WITH {_scores('documents', 'doc_id', _ASKING, 'doc_id', 'text', _EVAL)}, {_DENSE}" + _ZERO + _FUSED.replace("LEX_", "z").replace("LIMIT_", "50").replace("TOP_", "10"),
    "fanout_merge": _PER_CONTAINER.replace("ORDER_", "score DESC, container_id, crk"),
    "fanout_merge_by_container": _PER_CONTAINER.replace("ORDER_", "container_id, crk"),
    "rerank_promote": _TOP_TEXT.replace("TOP_", "10") + """, p AS (SELECT t.q_id, t.id, row_number() OVER (PARTITION BY t.q_id ORDER BY rk DESC) AS p FROM t JOIN g USING (q_id) WHERE wanted <> '' AND contains(d, wanted))
SELECT q_id, id, rk, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN p <= 3 THEN p END NULLS LAST, rk) AS new_rk FROM t LEFT JOIN p USING (q_id, id)""",
    "rerank_candidates": f"WITH {_GOLD}, r AS (SELECT * FROM (SELECT *, {_RANK} AS rk FROM s) WHERE rk <= 20) SELECT q_id, string_agg('[' || (rk - 1) || ']' || CASE WHEN coalesce(source, '') <> '' THEN ' (' || source || ')' ELSE '' END || ' ' || substr(coalesce(text, ''), 1, 240), chr(10) ORDER BY rk) AS candidates FROM r JOIN chunks ON r.id = row_id GROUP BY 1",
    "recall_at_k": _QUESTIONS + " SELECT count(*) AS questions, round(avg(hit1), 6) AS recall1, round(avg(hit3), 6) AS recall3, round(avg(oracle), 6) AS oracle FROM a",
    "fail_diagnosis": _QUESTIONS + " SELECT q_id, CASE WHEN oracle = 0 THEN 'no atom' ELSE 'rank > 3' END AS diagnosis, (SELECT string_agg(coalesce(source, ''), '; ' ORDER BY rk) FROM t WHERE t.q_id = a.q_id) AS sources FROM a WHERE hit3 = 0",
    "match_projection": f"WITH {_GOLD} SELECT q_id, rk, round(score, 4) AS score, row_id, source, substr(text, 1, 700) AS text, page, y, line_from, line_to, reader FROM (SELECT *, {_RANK} AS rk FROM s) r JOIN chunks ON r.id = row_id WHERE rk <= 8",
}
