"""Queries: from pages to row chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import COMPANY
from fathomline.operators import chunk, documents
from fathomline.queries.layouts import _CELLS, _SEGS, CODES, _codes, _from_text, _glyphs, _word_glyphs
from fathomline.session import table


def visible_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "boxes").select("row_id", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("row_id") % 5).alias("ink_sum"))
    return documents.visible(rows).select("row_id")


def word_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Each box as a glyph within the words that pairs of boxes of a line would make."""
    glyphs = _glyphs(spark, folder)
    words = glyphs.select("doc", "page", F.col("seq").alias("word_seq"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") * 2).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return documents.word_starts(glyphs, words)


def document_row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "fulltext").where("doc is not null").groupBy("doc").agg(F.min(F.substring_index("text", " ", 1)).alias("prefix"))
    cut = documents.row_chunks(_word_glyphs(spark, folder), names.withColumn("source", F.concat(F.lit("in/x_"), "doc", F.lit("-1.pdf"))))
    return chunk.numbered(cut, "doc", ["at", "win"], "text").select("doc", "seq", "text_id", "text")


def table_witness(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the glyph chunks as table rows."""
    rows = table(spark, folder, "fulltext").where("text is not null").select("doc", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("y", "line"))
    label = F.element_at(F.create_map(*(F.lit(x) for n, c in CODES.items() for x in (c, f"{n}. {c}"))), F.regexp_extract("line", "^([^:]+): ", 1))
    cells = F.array(F.coalesce(label, F.lit("")), F.regexp_extract("line", "([0-9.]+,[0-9]{2})", 1))
    return documents.table_witness(rows.select("doc", "page", "y", cells.alias("cells")), _codes(spark))


def employer_names(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "fulltext").where("text is not null").select(F.concat_ws("#", "doc", "row_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_seq", "text"))
    """Documents by turns with a labelled name, an address anchor above, an address as the first line, or none."""
    turn = F.substring_index("doc", "#", -1).cast("long") % 4
    first = F.col("line_seq") == 0
    made = F.when(first & (turn == 0), F.concat(F.lit("Name des Arbeitgebers: "), "text")).when(first & (turn == 2), F.concat("text", F.lit(" / 51373 Ort"))).otherwise(F.col("text"))
    anchors = lines.where(first & (turn == 1)).select("doc", "page", F.lit(-1).alias("line_seq"), F.lit("Anschrift des Arbeitgebers").alias("text"))
    lines = lines.select("doc", "page", "line_seq", made.alias("text")).unionByName(anchors)
    return documents.employers(lines.select("doc", "page", "line_seq", "text", F.lit(0.0).alias("x"), (F.col("line_seq") * 20.0).alias("y")))


def container_summary(spark: SparkSession, folder: str) -> DataFrame:
    return documents.summary(table(spark, folder, "fulltext").select("doc", "text"), _from_text(spark, folder), "Rechnungsbetrag")


def name_order(spark: SparkSession, folder: str) -> DataFrame:
    return documents.by_name(table(spark, folder, "nation").select("n_name"), F.col("n_name"))


QUERIES = {f.__name__: f for f in (visible_glyphs, word_starts, document_row_chunks, table_witness, employer_names, container_summary, name_order)}

_G = "g AS (SELECT doc, page, min(row_id) AS seq, x0 AS x, y0 AS y, round(x1 - x0, 3) AS w, round(y1 - y0, 3) AS h, text FROM boxes WHERE doc IS NOT NULL GROUP BY doc, page, text, x0, y0, x1, y1)"
_CASE = " ".join(f"WHEN '{c}' THEN '{n}. {c}'" for n, c in CODES.items())
_KEPT = r"(contains(text, ' | ') OR length(text) >= 25 OR regexp_matches(text, '(^|[^0-9.])([0-9]{1,3}([.][0-9]{3})+|[0-9]{1,5}),[0-9]{2}([^0-9]|$)'))"
_TRIM = r"regexp_replace({}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
ORACLE = {
    "document_row_chunks": _SEGS.replace("WITH ", "WITH RECURSIVE ", 1) + _CELLS + f""", fi AS (SELECT doc, min(string_split(text, ' ')[1]) AS prefix FROM fulltext WHERE doc IS NOT NULL GROUP BY 1),
rows_ AS (SELECT doc, page * 100000 + band AS at_, array_to_string(ts, ' | ') AS text FROM tr), first_ AS (SELECT doc, text, min(at_) AS at_ FROM rows_ WHERE {_KEPT} GROUP BY 1, 2),
b AS (SELECT first_.doc, at_, text, string_split(text, ' ') AS ws, CASE WHEN coalesce(prefix, '') <> '' THEN prefix || ' — ' ELSE '' END AS pre FROM first_ JOIN fi ON fi.doc = first_.doc),
f_ AS (SELECT doc, at_, pre, ws, 0 AS n, 0 AS win, pre AS buf, CAST(NULL AS VARCHAR) AS done FROM b WHERE length(pre) + length(text) > 480
UNION ALL SELECT doc, at_, pre, ws, n + 1, win + CAST(ov AS INT), CASE WHEN ov OR buf = pre THEN pre ELSE buf || ' ' END || ws[n + 1], CASE WHEN ov THEN buf END
  FROM (SELECT *, length(buf) + length(ws[n + 1]) + 1 > 480 AND buf <> pre AS ov FROM f_ WHERE n < len(ws))),
w_ AS (SELECT doc, at_, win - 1 AS win, done AS t FROM f_ WHERE done IS NOT NULL UNION ALL SELECT doc, at_, win, buf FROM f_ WHERE n = len(ws) AND buf <> pre UNION ALL SELECT doc, at_, 0, pre || text FROM b WHERE length(pre) + length(text) <= 480
  UNION ALL SELECT doc, -1, 0, 'Datenblatt SNR ' || doc_part || CASE WHEN coalesce(prefix, '') <> '' THEN ' · ' || prefix ELSE '' END FROM (SELECT *, string_split(string_split('x_' || string_split(doc, '/')[-1] || '-1.pdf', '_')[2], '-')[1] AS doc_part FROM fi)),
x_ AS (SELECT doc, at_, win, {_TRIM.format('t')} AS t FROM w_)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY at_, win) - 1 AS INT) AS seq, substr(sha256(t), 1, 16) AS text_id, substr(t, 1, 1400) AS text FROM x_ WHERE length(t) >= 20""",
    "visible_glyphs": "SELECT row_id FROM boxes WHERE x1 - x0 < 1 OR y1 - y0 < 1 OR row_id % 5 >= 1",
    "word_starts": f"""WITH {_G}, p AS (SELECT a.doc, a.page, a.seq, b.seq AS word_seq, CAST(row_number() OVER (PARTITION BY a.doc, a.page, b.seq ORDER BY a.x, a.seq) > 1 AS INT) AS wpos FROM g a JOIN g b ON a.doc = b.doc AND a.page = b.page
  AND a.x >= b.x - 1 AND a.x <= b.x + b.w * 2 + 1 AND a.y + a.h / 2 >= b.y - 2 AND a.y + a.h / 2 <= b.y + b.h + 2) SELECT doc, page, seq, max_by(wpos, word_seq) AS wpos FROM p GROUP BY 1, 2, 3""",
    "table_witness": rf"""WITH l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM fulltext WHERE text IS NOT NULL),
m AS (SELECT doc, y, CASE regexp_extract(line, '^([^:]+): ', 1) {_CASE} END AS lab, regexp_extract(line, '([0-9.]+,[0-9]{{2}})', 1) AS raw FROM l)
SELECT doc, substr(lab, 4) AS code, raw, 1 AS page, CAST(y AS INT) AS y FROM (SELECT *, row_number() OVER (PARTITION BY doc, lab ORDER BY y, raw) AS k FROM m WHERE lab IS NOT NULL AND regexp_matches(raw, '^([0-9]{{1,3}}([.][0-9]{{3}})+|[0-9]{{1,5}}),[0-9]{{2}}$')) WHERE k = 1""",
    "employer_names": rf"""WITH t AS (SELECT doc, row_id, string_split(text, chr(10)) AS ls, trim(string_split(text, chr(10))[1], ' |:') AS n, nullif(regexp_extract(text, '{COMPANY}'), '') AS firm FROM fulltext WHERE text IS NOT NULL),
a AS (SELECT *, CASE row_id % 4 WHEN 0 THEN CASE WHEN length(n) > 3 THEN n END WHEN 1 THEN list_filter(ls[1:6], lambda x: length(trim(x)) >= 3 AND NOT regexp_matches(trim(x), '^[0-9]') AND NOT regexp_matches(lower(trim(x)), '^(firma|herr|frau|name|steuernummer|anschrift|arbeitgeber)'))[1] END AS anchored,
  CASE WHEN row_id % 4 = 2 AND length(trim(ls[1])) BETWEEN 3 AND 60 AND NOT regexp_matches(lower(trim(ls[1])), '^(firma|herr|frau|name|steuernummer|anschrift|arbeitgeber)') THEN ls[1] END AS head FROM t),
e AS (SELECT doc, row_id, trim(regexp_replace(coalesce(trim(anchored), head, firm), '(?s)\s*[/,]\s*(Postfach|[0-9]{{5}}).*$', ''), ' /,-|') AS e FROM a)
SELECT concat_ws('#', doc, row_id) AS doc, CASE WHEN length(e) >= 3 THEN substr(e, 1, 60) END AS employer FROM e""",
    "container_summary": r"""WITH d AS (SELECT doc, max(CAST(trim(coalesce(text, '')) <> '' AS INT)) AS r FROM fulltext GROUP BY doc),
l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM fulltext WHERE text IS NOT NULL),
v AS (SELECT DISTINCT doc, regexp_extract(line, '^([^:]+): ', 1) AS code FROM l WHERE regexp_matches(line, ': ([0-9][0-9.]*,[0-9]{2})'))
SELECT (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM d WHERE r = 0) AS scans, (SELECT count(*) FROM v WHERE code IN CODES_) AS claims, (SELECT count(DISTINCT doc) FROM v WHERE code = 'Rechnungsbetrag') AS wage_docs""".replace("CODES_", str(tuple(CODES.values()))),
    "name_order": "SELECT n_name FROM nation ORDER BY lower(n_name), n_name",
}
