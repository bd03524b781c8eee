"""Queries: ids, chunking, deduplication, scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import chunk
from fathomline.session import table


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.content_id("text").alias("lite_id"), T.content_id("text", "sha256").alias("build_id"))


def dedup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").withColumn("source", F.coalesce("source", F.lit("")))
    return chunk.first_by_content(docs, "text", ["source", "doc_id"]).select("doc_id", "source")


def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.paragraphs(table(spark, folder, "documents"), "doc_id", F.col("text")).select("id", "line_from", "line_to", "text")


def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.greedy(table(spark, folder, "documents"), "doc_id", F.split("text", "\n\n"))


def word_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.word_windows(table(spark, folder, "documents"), "doc_id", F.col("text"), F.concat("doc_type", F.lit(" — ")))


def char_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.char_windows(table(spark, folder, "documents"), "doc_id", F.col("text"))


def keep_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("reader = 'glyph'")
    return rows.select("row_id", chunk.keep_row(F.col("text")).alias("kept"), chunk.keep_row(F.col("text"), lite=True).alias("kept_lite"))


def row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Kept rows, the first of equal ones, cut into word windows, then long enough ones numbered."""
    rows = chunk.first_rows(table(spark, folder, "chunks").where("reader = 'glyph'").select("doc", "row_id", "text"), "doc", "row_id", "text")
    cut = chunk.word_windows(rows.withColumn("key", F.struct("doc", "row_id")), "key", F.col("text"), F.lit("")).select("id.doc", "id.row_id", "win", "text")
    return chunk.numbered(cut, "doc", ["row_id", "win"], "text")


def header_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fulltext").select("row_id", chunk.header_prefix(F.col("text")).alias("prefix"))


def money_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "boxes").where(T.is_money("text")).select("row_id", "doc", "text")


def numeric_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts as four kinds of misreading write them, and as repaired."""
    amount = F.format_number("l_extendedprice", 2)
    german = F.translate(F.translate(F.translate(amount, ",", "#"), ".", ","), "#", ".")
    kinds = F.explode(F.array(F.concat(german, F.lit(" EUR")), F.replace(german, F.lit(","), F.lit(";")), F.replace(german, F.lit(","), F.lit(" | ")), F.replace(german, F.lit(","), F.lit("."))))
    rows = table(spark, folder, "lineitem").select(kinds.alias("misread")).distinct()
    return rows.select("misread", T.repaired("misread").alias("repaired"), T.is_money(T.repaired("misread")).alias("money"))


def digits_only(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold").select("q_id", T.digits("value").alias("digits"))


def number_variants(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "claims_in").select("row_id", F.array_join(F.array_sort(T.number_variants("value")), " / ").alias("variants"))


def telling_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "claims_in").select("row_id", T.telling_word("attribute").alias("word"))


def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return chunks.select("row_id", T.compact("text").alias("compact"), T.clean_employer("text").alias("employer"), T.number_in_name("source").alias("number"), T.year_after("text", "Zustand|Prüfdatum").alias("year"), T.row_label("text").alias("label"))


QUERIES = {f.__name__: f for f in (
    content_ids, dedup_first_wins, paragraph_chunks, greedy_chunks, word_windows, char_windows, keep_rows, row_chunks, header_prefix,
    money_tokens, numeric_repair, digits_only, number_variants, telling_words, scalar_functions,
)}

_TRIM = r"regexp_replace({}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_MONEY_IN = r"(^|[^0-9.])([0-9]{1,3}([.][0-9]{3})+|[0-9]{1,5}),[0-9]{2}([^0-9]|$)"
_G = r"[0-9]{1,3}(?:[.][0-9]{3})+"
_REPAIR = r"regexp_replace(misread, '\s*€|\s*\bEUR\b', '', 'g')"
for _p in (r"([0-9]);([0-9]{2})\b", r"([0-9])\s*[|]\s*([0-9]{2})\b", rf"({_G})[.]([0-9]{{2}})\b", rf"(\b{_G})([0-9]{{2}})\b", rf"(\b{_G}) ([0-9]{{2}})\b"):
    _REPAIR = rf"regexp_replace({_REPAIR}, '{_p}', '\1,\2', 'g')"
_REPAIR = rf"(CASE WHEN regexp_matches(trim({_REPAIR}), '^[0-9]{{1,5}} [0-9]{{2}}$') THEN replace(trim({_REPAIR}), ' ', ',') ELSE {_REPAIR} END)"
#: A name up to a slash or comma before a postbox or postcode, stripped; of at least three characters.
_EMPLOYER = r"trim(regexp_replace({}, '(?s)\s*[/,]\s*(Postfach|[0-9]{{5}}).*$', ''), ' /,-|')"

ORACLE = {
    "content_ids": "SELECT doc_id, substr(sha1(text), 1, 16) AS lite_id, substr(sha256(text), 1, 16) AS build_id FROM documents",
    "dedup_first_wins": "SELECT doc_id, source FROM (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY text ORDER BY coalesce(source, ''), doc_id) AS n FROM documents) WHERE n = 1",
    "paragraph_chunks": f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
g AS (SELECT *, sum(CAST({_TRIM.format('line')} = '' AS INT)) OVER (PARTITION BY id ORDER BY n) AS grp FROM l),
p AS (SELECT id, CAST(min(n) AS INT) AS line_from, CAST(max(n) AS INT) AS line_to, {_TRIM.format("string_agg(line, chr(10) ORDER BY n)")} AS text FROM g WHERE {_TRIM.format('line')} <> '' GROUP BY id, grp)
SELECT * FROM p WHERE length(text) > 20""",
    "greedy_chunks": f"""WITH RECURSIVE b AS (SELECT doc_id AS id, string_split(text, chr(10) || chr(10)) AS bs FROM documents),
f AS (SELECT id, bs, 0 AS n, CAST(NULL AS VARCHAR) AS done, 0 AS dseq, '' AS buf, 0 AS seq FROM b
UNION ALL SELECT id, bs, n + 1, CASE WHEN length(j) >= 900 THEN j END, s, CASE WHEN length(j) >= 900 THEN '' ELSE j END, s
  FROM (SELECT *, CASE WHEN buf = '' THEN bs[n + 1] ELSE buf || chr(10) || chr(10) || bs[n + 1] END AS j, CASE WHEN buf = '' THEN n ELSE seq END AS s FROM f WHERE n < len(bs))),
o AS (SELECT id, dseq AS seq, {_TRIM.format('done')} AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT id, seq, {_TRIM.format('buf')} FROM f WHERE n = len(bs))
SELECT id, seq, substr(sha256(t), 1, 16) AS text_id, substr(t, 1, 1400) AS text FROM o WHERE length(t) >= 120""",
    "word_windows": """WITH RECURSIVE b AS (SELECT doc_id AS id, coalesce(doc_type || ' — ', '') AS pre, text, string_split(text, ' ') AS ws FROM documents),
f AS (SELECT id, pre, ws, 0 AS n, 0 AS win, pre AS buf, CAST(NULL AS VARCHAR) AS done FROM b WHERE length(pre) + length(text) > 480
UNION ALL SELECT id, pre, ws, n + 1, win + CAST(ov AS INT), CASE WHEN ov OR buf = pre THEN pre ELSE buf || ' ' END || ws[n + 1], CASE WHEN ov THEN buf END
  FROM (SELECT *, length(buf) + length(ws[n + 1]) + 1 > 480 AND buf <> pre AS ov FROM f WHERE n < len(ws)))
SELECT id, win - 1 AS win, done AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT id, win, buf FROM f WHERE n = len(ws) AND buf <> pre
UNION ALL SELECT id, 0, pre || text FROM b WHERE length(pre) + length(text) <= 480""",
    "char_windows": "SELECT doc_id AS id, CAST(s AS INT) AS start, substr(text, s + 1, 480) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 460)) AS s FROM documents WHERE length(text) > 0)",
    "keep_rows": f"SELECT row_id, coalesce(contains(text, ' | ') OR length(text) >= 25 OR regexp_matches(text, '{_MONEY_IN}'), false) AS kept, coalesce(contains(text, ' | ') OR length(text) >= 25 OR regexp_matches(text, '[0-9]'), false) AS kept_lite FROM chunks WHERE reader = 'glyph'",
    "row_chunks": rf"""WITH RECURSIVE k AS (SELECT doc, row_id, {_TRIM.format('text')} AS text FROM chunks WHERE reader = 'glyph'),
r AS (SELECT doc, text, min(row_id) AS row_id FROM k WHERE contains(text, ' | ') OR length(text) >= 25 OR regexp_matches(text, '{_MONEY_IN}') GROUP BY 1, 2),
f AS (SELECT doc, row_id, string_split(text, ' ') AS ws, 0 AS n, 0 AS win, '' AS buf, CAST(NULL AS VARCHAR) AS done FROM r WHERE length(text) > 480
UNION ALL SELECT doc, row_id, ws, n + 1, win + CAST(ov AS INT), CASE WHEN ov OR buf = '' THEN '' ELSE buf || ' ' END || ws[n + 1], CASE WHEN ov THEN buf END
  FROM (SELECT *, length(buf) + length(ws[n + 1]) + 1 > 480 AND buf <> '' AS ov FROM f WHERE n < len(ws))),
w AS (SELECT doc, row_id, win - 1 AS win, done AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT doc, row_id, win, buf FROM f WHERE n = len(ws) AND buf <> '' UNION ALL SELECT doc, row_id, 0, text FROM r WHERE length(text) <= 480),
x AS (SELECT doc, row_id, win, {_TRIM.format('t')} AS t FROM w)
SELECT doc, row_id, win, CAST(row_number() OVER (PARTITION BY doc ORDER BY row_id, win) - 1 AS INT) AS seq, substr(sha256(t), 1, 16) AS text_id, substr(t, 1, 1400) AS text FROM x WHERE length(t) >= 20""",
    "header_prefix": rf"""SELECT row_id, coalesce(nullif(trim(regexp_replace(regexp_extract(text, '{T.COMPANY}'), '\s+', ' ', 'g')), ''),
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: length(x) > 8)[1], '') AS prefix FROM fulltext""",
    "money_tokens": f"SELECT row_id, doc, text FROM boxes WHERE regexp_matches(text, '{T.MONEY}')",
    "numeric_repair": f"""WITH a AS (SELECT DISTINCT translate(format('{{:,.2f}}', l_extendedprice), ',.', '.,') AS g FROM lineitem),
m AS (SELECT DISTINCT unnest([g || ' EUR', replace(g, ',', ';'), replace(g, ',', ' | '), replace(g, ',', '.')]) AS misread FROM a)
SELECT misread, {_REPAIR} AS repaired, regexp_matches({_REPAIR}, '{T.MONEY}') AS money FROM m""",
    "digits_only": "SELECT q_id, regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g') AS digits FROM gold",
    "number_variants": "SELECT row_id, CASE WHEN trim(coalesce(value, '')) = '' THEN '' ELSE array_to_string(list_sort(list_distinct([trim(value), regexp_replace(trim(value), '[.]0$', ''), replace(trim(value), '.', ',')])), ' / ') END AS variants FROM claims_in",
    "telling_words": "WITH w AS (SELECT row_id, attribute, regexp_extract_all(attribute, '[A-Za-zÄÖÜäöüß]{4,}') AS ws FROM claims_in) SELECT row_id, coalesce(list_filter(ws, lambda x: length(x) = list_max(list_transform(ws, lambda y: length(y))))[1], attribute) AS word FROM w",
    "scalar_functions": rf"""SELECT row_id, lower(regexp_replace(text, '\s+', '', 'g')) AS compact, CASE WHEN length(e) >= 3 THEN substr(e, 1, 60) END AS employer,
  CASE WHEN contains(name, '_') THEN string_split(string_split(name, '_')[2], '-')[1] ELSE regexp_replace(name, '(.)[.][^.]*$', '\1') END AS number,
  coalesce(nullif(regexp_extract(text, '(?:Zustand|Prüfdatum)[^0-9]{{0,30}}\b(20[0-9]{{2}})\b', 1), ''), '2024') AS year, try_cast(regexp_extract(text, '{T.ROW_LABEL}', 1) AS INT) AS label
FROM (SELECT *, {_EMPLOYER.format('text')} AS e, string_split(source, '/')[-1] AS name FROM chunks)""",
}
