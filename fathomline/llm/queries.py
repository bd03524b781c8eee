"""Registered queries of the corpus operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.keys import BLANKS
from fathomline.llm.copies import collapse_copies
from fathomline.llm.enrich import distinctive_in, distinctive_links, distinctive_terms, rare_links
from fathomline.llm.leaks import find_leaks
from fathomline.llm.mixture import mix
from fathomline.llm.neighbours import loss_card, nearest, route
from fathomline.llm.reading import ReadingModel, fit_reading, level_profile, reading_levels
from fathomline.llm.split import split_oversized
from fathomline.session import table


def _chunk_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    glyph = F.coalesce(F.col("reader") == "glyph", F.lit(False))
    return collapse_copies(table(spark, folder, "chunks"), "row_id", F.col("text"), glyph)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    _, copies = _chunk_copies(spark, folder)
    return copies.select(F.col("first_id").alias("first_row"), F.col("copy_id").alias("copy_row"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    records, _ = _chunk_copies(spark, folder)
    return records.select(F.col("id").alias("row_id"), "copies").join(table(spark, folder, "chunks").select("row_id", "id", "text"), "row_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(table(spark, folder, "chunks"), "row_id", F.col("text"), F.col("seq"))
    return pieces.withColumnRenamed("id", "row_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece = 0").select("row_id")


def p3_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts put together again from their pieces without what these share, and whether the pieces keep the
    size and overlap, end at blanks where the text has any near, and have text of their own."""
    pieces = p3_pieces(spark, folder).join(table(spark, folder, "chunks").select("row_id", F.col("text").alias("whole")), "row_id")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("row_id").orderBy("piece")), F.lit(0))
    rows = pieces.withColumn("before", before).withColumn("own", F.expr("substring(text, before - start + 1)"))
    natural = (F.col("end") == F.char_length("whole")) | F.expr("substring(whole, end + 1, 1)").rlike(BLANKS) | ~F.expr("substring(whole, before + 351, start + 1400 - before - 350)").rlike(rf"(?!{BLANKS}).{BLANKS}")
    ok = (F.char_length("text") <= 1400) & ((F.col("piece") == 0) | (F.col("before") - F.col("start")).between(0, 100)) & ((F.col("end") - F.col("before") >= 350) | (F.col("end") == F.char_length("whole"))) & natural
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda p: p["own"])
    return rows.groupBy("row_id").agg(F.md5(F.array_join(parts, "")).alias("md5"), F.bool_and(ok).alias("kept"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    gold, chunks = table(spark, folder, "gold"), table(spark, folder, "chunks")
    links = distinctive_links(gold, "q_id", F.col("q"), chunks, "row_id", F.col("text"), 6)
    return links.select(F.col("query_id").alias("q_id"), "row_id", "term", F.round("query_score", 2).alias("query_score"), F.round("row_score", 2).alias("row_score"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cases are defined by df alone, so no score is computed for them; p4_links has the scores."""
    links = rare_links(table(spark, folder, "gold"), "q_id", F.col("q"), table(spark, folder, "chunks"), "row_id", F.col("text"), 6)
    return links.select(F.col("query_id").alias("q_id"), "row_id").distinct()


def p4_question_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = distinctive_in(table(spark, folder, "gold"), "q_id", F.col("q"), table(spark, folder, "chunks"), "row_id", F.col("text"))
    return terms.withColumnRenamed("id", "q_id").withColumn("score", F.round("score", 2))


def p4_chunk_terms(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive_terms(table(spark, folder, "chunks"), "row_id", F.col("text")).withColumnRenamed("id", "row_id").withColumn("score", F.round("score", 2))


def _routed(spark: SparkSession, folder: str, close: float | None = None):
    return route(table(spark, folder, "vectors"), "vec_id", F.col("embedding"), 64, close)


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_routed(spark, folder)).withColumnsRenamed({"id": "vec_id", "other": "neighbour"})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ten most similar those that are close: the search asks the parts where they can be."""
    close = nearest(_routed(spark, folder, 0.9), least=0.9)
    return close.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p5_card(spark: SparkSession, folder: str) -> DataFrame:
    return loss_card(_routed(spark, folder))


def p5_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the search finds nine tenths of the exact ten neighbours, and 98 % of their similarity."""
    card = loss_card(_routed(spark, folder))
    return card.select("n_vectors", "n_queries", (F.col("id_recall_at_10") >= 0.9).alias("ids"), (F.col("score_recall_at_10") >= 0.98).alias("scores"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), "doc_id", F.col("text"), table(spark, folder, "eval_items"), "item_id", F.col("text"))


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id", "distance", "words")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """A passage of 12 words stands unchanged where its least distance is 0."""
    return _leaks(spark, folder).where("distance = 0 and words = 12").select("doc_id", "item_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("source"), table(spark, folder, "source_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    chosen, _ = _mixed(spark, folder)
    return chosen.select(F.col("id").alias("doc_id"), "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def _model(spark: SparkSession, folder: str) -> ReadingModel:
    return fit_reading(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("source"), table(spark, folder, "reading_labels"))


def _levels(spark: SparkSession, folder: str, model: ReadingModel | None) -> DataFrame:
    levels = reading_levels(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("source"), F.col("lang"), model)
    return levels.withColumnRenamed("id", "doc_id")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder, _model(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates are the documents whose grade reaches the least that the model can give to a text of the
    wanted kind; of them the exact count decides. Without enough graded documents all are candidates."""
    model = _model(spark, folder)
    levels = _levels(spark, folder, model)
    if model:
        levels = levels.where(F.col("grade") >= model.least_grade(words=40, lix=62))
    return levels.where("words >= 40 and lix >= 62").select("doc_id")


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts behind the levels."""
    return p8_levels(spark, folder).select("doc_id", "source", "words", "sentences", "long_words", F.round("lix", 6).alias("lix"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    return level_profile(p8_levels(spark, folder))


def p8_folds(spark: SparkSession, folder: str) -> DataFrame:
    model = _model(spark, folder)
    return spark.createDataFrame(model.folds if model else [], "fold int, docs int, error double, error_of_mean double, within_half double")


QUERIES = {
    "p1_found": p1_found, "p1_records": p1_records, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt,
    "p4_found": p4_found, "p4_links": p4_links, "p4_question_terms": p4_question_terms, "p4_chunk_terms": p4_chunk_terms,
    "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_card": p5_card, "p5_reached": p5_reached, "p6_found": p6_found, "p6_leaks": p6_leaks,
    "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_levels": p8_levels, "p8_counts": p8_counts, "p8_profile": p8_profile, "p8_folds": p8_folds,
}

_P1 = r"""
WITH base AS (
  SELECT row_id, coalesce(reader = 'glyph', false) AS g,
         CASE WHEN coalesce(reader = 'glyph', false) THEN
           CASE WHEN regexp_matches(text, '^\s*\{') THEN regexp_extract_all(text, '"[^"]*"\s*:\s*"[^"]*"')
                ELSE regexp_split_to_array(text, '[|;\t\n\r]') END
         ELSE [text] END AS parts
  FROM chunks WHERE text IS NOT NULL),
keyed AS (
  SELECT row_id, g, list_sort(list_filter(list_transform(parts, lambda p: array_to_string(list_transform(
           regexp_extract_all(replace(lower(p), 'ß', 'ss'), '\p{Nd}+(?:[.,]\p{Nd}+)*|\p{L}+'),
           lambda t: CASE WHEN regexp_matches(t, '^\p{Nd}') THEN '<' || t || '>' ELSE t END), '')), lambda k: k <> '')) AS key
  FROM base)
"""

_TERMS = r"regexp_extract_all(replace(lower(coalesce({}, '')), 'ß', 'ss'), '\p{{L}}{{2,}}|\p{{Nd}}{{2,}}')"


def _tails(rows: str, t: str = "") -> str:
    """Of rows (id, term, k, n, in_all, df, size_all): the adjusted score by sums of log-gammas, as table sc with
    the suffix ``t``."""
    lf = lambda x: f"lgamma({x} + 1)"
    pmf = lambda i: f"({lf('n')} - {lf(i)} - {lf(f'n - {i}')} + {lf('size_all - n')} - {lf(f'in_all - {i}')} - {lf(f'size_all - n - in_all + {i}')} + {lf('in_all')} + {lf('size_all - in_all')} - {lf('size_all')})"
    return f"""pr{t} AS (SELECT *, k * size_all > n * in_all AS up, greatest(0, n + in_all - size_all) AS low FROM {rows}),
ex{t} AS (SELECT *, CASE WHEN k <= low THEN [] WHEN up THEN range(k, least(n, in_all, k + 400) + 1) ELSE range(low, k) END AS steps FROM pr{t}),
su{t} AS (SELECT id, term, k, n, in_all, df, up, low, CASE WHEN k <= low THEN 0 ELSE list_sum(list_transform(steps, lambda i: exp({pmf('i')} - CASE WHEN up THEN {pmf('k')} ELSE 0 END))) END AS total, CASE WHEN up THEN {pmf('k')} ELSE 0 END AS first FROM ex{t}),
lp{t} AS (SELECT id, term, k, n, in_all, df, CASE WHEN k <= low THEN 0 WHEN up THEN least(0, first + ln(total)) ELSE ln(1 - least(total, 1 - 1e-16)) END AS log_p FROM su{t}),
rk{t} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_p, term) AS rank, count(*) OVER (PARTITION BY id) AS tests FROM lp{t}),
sc{t} AS (SELECT id, term, k, n, in_all, df, -least(min(log_p + ln(tests / rank)) OVER (PARTITION BY id ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 0) AS score FROM rk{t})"""


_COUNTS = f"""WITH cw AS (SELECT row_id AS id, {_TERMS.format('text')} AS w FROM chunks),
ct AS (SELECT id, term, any_value(n) AS n, count(*) AS k FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM cw) GROUP BY 1, 2),
cs AS (SELECT term, CAST(sum(k) AS BIGINT) AS in_all, count(*) AS df FROM ct GROUP BY 1), tot AS (SELECT CAST(sum(len(w)) AS BIGINT) AS size_all FROM cw),
cr AS (SELECT ct.*, in_all, df, size_all FROM ct JOIN cs USING (term) CROSS JOIN tot),
qw AS (SELECT q_id AS id, {_TERMS.format('q')} AS w FROM gold), qt AS (SELECT id, term, any_value(n) AS n, count(*) AS k FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM qw) GROUP BY 1, 2),
qr AS (SELECT qt.*, coalesce(in_all, 0) + k AS in_all, coalesce(df, 0) AS df, size_all + n AS size_all FROM qt LEFT JOIN cs USING (term) CROSS JOIN tot)"""
_P6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\p{L}+|\p{Nd}+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\p{L}+|\p{Nd}+') AS w FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT item_id, w[i:i + 11] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
win AS (SELECT doc_id, len_, w[i:i + len_ - 1] AS p FROM (SELECT doc_id, w, len_, unnest(range(1, len(w) - len_ + 2)) AS i FROM d, (VALUES (11), (12), (13)) v(len_))),
whole AS (SELECT DISTINCT doc_id, item_id FROM win JOIN p ON len_ = 12 AND array_to_string(win.p, ' ') = array_to_string(p.p, ' ')),
pm AS (SELECT item_id, j, array_to_string(p[1:j - 1], ' ') || ' _ ' || array_to_string(p[j + 1:12], ' ') AS g, array_to_string(list_concat(p[1:j - 1], p[j + 1:12]), ' ') AS g11, array_to_string(p, ' ') AS g12 FROM (SELECT *, unnest(range(1, 13)) AS j FROM p)),
wm AS (SELECT doc_id, len_, j, array_to_string(p[1:j - 1], ' ') || ' _ ' || array_to_string(p[j + 1:12], ' ') AS g, array_to_string(list_concat(p[1:j - 1], p[j + 1:13]), ' ') AS g12 FROM (SELECT *, unnest(range(1, len_ + 1)) AS j FROM win WHERE len_ > 11)),
near AS (SELECT doc_id, item_id FROM wm JOIN pm ON len_ = 12 AND wm.g = pm.g UNION SELECT doc_id, item_id FROM wm JOIN pm ON len_ = 13 AND wm.g12 = pm.g12 UNION SELECT doc_id, item_id FROM win JOIN pm ON len_ = 11 AND array_to_string(win.p, ' ') = pm.g11),
short AS (SELECT DISTINCT doc_id, item_id, len(e.w) AS words FROM e JOIN d ON len(e.w) BETWEEN 1 AND 11 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' '))
SELECT doc_id, item_id, 0 AS distance, 12 AS words FROM whole UNION ALL SELECT doc_id, item_id, 1, 12 FROM (SELECT * FROM near EXCEPT SELECT * FROM whole) UNION ALL SELECT doc_id, item_id, 0, CAST(words AS INT) FROM short"""

ORACLE = {
    "p4_chunk_terms": _COUNTS + ", " + _tails("cr") + " SELECT id AS row_id, term, k, n, in_all, df, round(score, 2) AS score FROM sc",
    "p4_question_terms": _COUNTS + ", " + _tails("qr") + " SELECT id AS q_id, term, k, n, in_all, df, round(score, 2) AS score FROM sc",
    "p4_links": f"{_COUNTS}, {_tails('cr')}, {_tails('qr', '_q')} SELECT q.id AS q_id, c.id AS row_id, term, round(q.score, 2) AS query_score, round(c.score, 2) AS row_score FROM sc c JOIN sc_q q USING (term) WHERE c.df <= 6",
    "p3_rebuilt": "SELECT row_id, md5(text) AS md5, true AS kept FROM chunks WHERE length(text) > 1400",
    "p5_reached": """WITH v AS (SELECT vec_id FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT count(*) AS n_vectors, count(*) FILTER (WHERE vec_id % 20 = 0) AS n_queries, true AS ids, true AS scores FROM v""",
    "p8_counts": r"""
WITH d AS (SELECT doc_id, source, replace(lower(coalesce(text, '')), 'ß', 'ss') AS t FROM documents),
w AS (SELECT doc_id, nullif(lower(regexp_replace(source, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS source, regexp_extract_all(t, '\p{L}+') AS w,
  len(list_filter(regexp_split_to_array(t, '[.!?](?:BLANK_|$)|\n[ \t\r\x{a0}]*\n'), lambda s: regexp_matches(s, '\p{L}'))) AS s FROM d),
c AS (SELECT doc_id, source, len(w) AS n, s, len(list_filter(w, lambda x: length(x) > 6)) AS l FROM w)
SELECT doc_id, source, CAST(n AS INT) AS words, CAST(s AS INT) AS sentences, CAST(l AS INT) AS long_words, CASE WHEN n = 0 THEN 0 ELSE round(n / s + 100.0 * l / n, 6) END AS lix FROM c""".replace("BLANK_", BLANKS),
    "p6_leaks": _P6,
    "p1_found": _P1 + """, grouped AS (SELECT min(row_id) OVER (PARTITION BY g, key) AS first_row, row_id AS copy_row FROM keyed WHERE len(key) > 0)
SELECT first_row, copy_row FROM grouped WHERE first_row <> copy_row""",
    "p3_found": "SELECT row_id FROM chunks WHERE length(text) > 1400",
    "p4_found": r"""
WITH t AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\p{L}{2,}|\p{Nd}{2,}'))) AS term FROM chunks),
rare AS (SELECT term FROM t GROUP BY term HAVING count(*) <= 6),
g AS (SELECT q_id, unnest(list_distinct(regexp_extract_all(replace(lower(q), 'ß', 'ss'), '\p{L}{2,}|\p{Nd}{2,}'))) AS term FROM gold)
SELECT DISTINCT q_id, row_id FROM g JOIN rare USING (term) JOIN t USING (term)""",
    "p1_records": _P1 + """, r AS (SELECT min(row_id) AS row_id, count(*) AS copies FROM keyed WHERE len(key) > 0 GROUP BY g, key)
SELECT r.row_id, copies, id, text FROM r JOIN chunks USING (row_id)""",
    "p5_found": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\p{L}+|\p{Nd}+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\p{L}+|\p{Nd}+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '\p{L}+') AS w,
  len(list_filter(regexp_split_to_array(t, '[.!?](?:\s|$)|\n[ \t\r]*\n'), lambda s: regexp_matches(s, '\p{L}'))) AS s FROM d)
SELECT doc_id FROM w WHERE len(w) >= 40 AND len(w) / s + 100.0 * len(list_filter(w, lambda x: length(x) > 6)) / len(w) >= 62""",
}
