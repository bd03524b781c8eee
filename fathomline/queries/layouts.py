"""Queries: layout of word boxes, pairing of labels and amounts, witnesses, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import is_money
from fathomline.operators import claims, layout
from fathomline.session import table

# The form rows that the test documents' labels stand for, and the fields' types.
CODES = {3: "Rechnungsbetrag", 4: "Gesamtgewicht", 5: "Förderhöhe", 6: "Betriebsdruck", 7: "Nennleistung"}
KEYWORDS = [("Anschlußwert", ("anschlu",), ("und",)), ("Lagerort", ("lagerort",), ()), ("Solidaritätszuschlag", ("olidar",), ("und10", "9und"))]
CURRENCY = ("Rechnungsbetrag", "Bruttoarbeitslohn", "Solidaritätszuschlag", "Einbehaltene Lohnsteuer")
DAYS = [str(n) for n in range(1, 32)]


def _word_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """Each box begins a word."""
    return _glyphs(spark, folder).withColumn("wpos", F.lit(0))


def _glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct word box as a glyph; boxes read twice count once."""
    rows = table(spark, folder, "boxes").where("doc is not null")
    rows = rows.groupBy("doc", "page", F.col("text").alias("label"), F.col("x0").alias("x"), F.col("y0").alias("y"), "x1", "y1").agg(F.min("row_id").alias("seq"))
    return rows.select("doc", "page", "seq", "label", "x", "y", F.round(F.col("x1") - F.col("x"), 3).alias("w"), F.round(F.col("y1") - F.col("y"), 3).alias("h"), F.lit(None).cast("int").alias("wpos"))


def y_bands(spark: SparkSession, folder: str) -> DataFrame:
    return layout.y_bands(_glyphs(spark, folder)).select("doc", "page", *(F.col(c).cast("long").alias(c) for c in ("band", "top", "bottom")))


def x_segments(spark: SparkSession, folder: str) -> DataFrame:
    segs = layout.x_segments(layout.in_bands(layout.sized(_glyphs(spark, folder))))
    return segs.groupBy("doc", "page", "band", "seg").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n"))


def column_anchors(spark: SparkSession, folder: str) -> DataFrame:
    cols = layout.columns(layout.x_segments(layout.in_bands(layout.sized(_glyphs(spark, folder)))))
    return cols.select("doc", "page", F.posexplode("centers").alias("col", "center"))


def cell_text_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layout.table_rows(_word_glyphs(spark, folder))


def _lined(spark: SparkSession, folder: str) -> DataFrame:
    return _glyphs(spark, folder).withColumns({"block": F.lit(0), "line": F.floor(F.col("y") / 14).cast("int"), "size_pt": F.col("h")})


def sub_super_flags(spark: SparkSession, folder: str) -> DataFrame:
    return layout.raised(_lined(spark, folder)).select("doc", "page", "line", "seq", "mark")


def glyph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return layout.neighbours_and_words(_lined(spark, folder)).select("doc", "page", "line", "seq", "left", "right", "wpos")


def span_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.merged_spans(_lined(spark, folder)).select("doc", "page", "line", F.col("seg").cast("int").alias("seg"), "text", "x", F.round("x2", 3).alias("x2"))


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES.items()), "number int, code string")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Word boxes as lines; a box that is a known label gets its form row's number."""
    text = F.col("label")
    for number, code in CODES.items():
        text = F.when(F.col("label") == code, f"{number}. {code}").otherwise(text)
    return _glyphs(spark, folder).select("doc", "page", F.row_number().over(layout.Window.partitionBy("doc", "page").orderBy("seq")).alias("line_seq"), text.alias("text"), "x", "y", F.round(F.col("x") + F.col("w"), 3).alias("x2"))


def row_anchor_pairing(spark: SparkSession, folder: str) -> DataFrame:
    return claims.row_anchors(_lines(spark, folder), _codes(spark))


def positional_pairing(spark: SparkSession, folder: str) -> DataFrame:
    none = spark.createDataFrame([], claims.VALUES)
    return claims.greedy_pairs(_lines(spark, folder), none, CODES, [])


def keyword_pairing(spark: SparkSession, folder: str) -> DataFrame:
    return claims.greedy_pairs(_lines(spark, folder), row_anchor_pairing(spark, folder), CODES, KEYWORDS)


def euro_cent_merge(spark: SparkSession, folder: str) -> DataFrame:
    return claims.joined_cents(_lines(spark, folder)).where(is_money("text"))


def _from_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "fulltext").where("text is not null").select("doc", "row_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    label = F.regexp_extract("line", r"^([^:]+): ", 1)
    raw = F.regexp_extract("line", r": ([0-9][0-9.]*,[0-9]{2})", 1)
    rows = lines.select("doc", "row_id", "n", label.alias("code"), raw.alias("raw")).where(F.col("code").isin(*CODES.values()) & (F.col("raw") != ""))
    return rows.groupBy("doc", "code").agg(F.min_by("raw", F.struct("row_id", "n")).alias("raw"), F.lit(1).alias("page"), F.lit(0.0).alias("y"))


def witness_merge(spark: SparkSession, folder: str) -> DataFrame:
    first = row_anchor_pairing(spark, folder).select("doc", F.lit(1).alias("witness_rank"), F.lit("boxes").alias("source"), "code", "raw", "page", "y")
    second = _from_text(spark, folder).select("doc", F.lit(2).alias("witness_rank"), F.lit("text").alias("source"), "code", "raw", "page", "y")
    merged = claims.merged_witnesses(first.unionByName(second))
    return merged.select("doc", "code", "value", "page", "witnesses", F.array_join("sources", ",").alias("sources"))


def claim_validate(spark: SparkSession, folder: str) -> DataFrame:
    catalog = spark.createDataFrame([(c, "currency", []) for c in CURRENCY] + [("Zahl der Arbeitstage", "enum", DAYS)], "code string, datentyp string, enum array<string>")
    values = table(spark, folder, "claims_in").select("row_id", F.col("attribute").alias("code"), "value")
    return claims.validated(values, catalog).select("row_id", "code", "datentyp", "valid")


def claim_texts(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.createDataFrame([(c, f"Zeile {n}") for n, c in CODES.items()], "code string, label string")
    fields = spark.createDataFrame([(c, "N" if n % 2 else "", n) for n, c in CODES.items()], "code string, section string, row int")
    employer = F.nullif(F.regexp_extract("subject", "^([^ ]+)", 1), F.lit(""))
    values = table(spark, folder, "claims_in").select("row_id", F.col("attribute").alias("code"), "value", employer.alias("employer"), F.lit("2024").alias("year"))
    return claims.claim_texts(values, labels, "Bescheinigung", fields).select("row_id", "id", "text")


QUERIES = {f.__name__: f for f in (
    y_bands, x_segments, column_anchors, cell_text_rows, sub_super_flags, glyph_neighbours, span_lines, row_anchor_pairing, positional_pairing,
    keyword_pairing, euro_cent_merge, witness_merge, claim_validate, claim_texts,
)}

_G = """g AS (SELECT doc, page, min(row_id) AS seq, text AS label, x0 AS x, y0 AS y, round(x1 - x0, 3) AS w, round(y1 - y0, 3) AS h FROM boxes WHERE doc IS NOT NULL GROUP BY doc, page, text, x0, y0, x1, y1)"""
_B = """s AS (SELECT DISTINCT doc, page, CAST(floor(y) AS BIGINT) AS a, CAST(floor(y + h) AS BIGINT) AS b FROM GL_),
n AS (SELECT *, coalesce(CAST(a > max(b) OVER (PARTITION BY doc, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS INT), 1) AS new FROM s),
o AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS band FROM n),
bands AS (SELECT doc, page, CAST(band AS BIGINT) AS band, min(a) AS top, max(b) AS bottom FROM o GROUP BY 1, 2, 3)"""
_SEGS = f"""WITH {_G}, z AS (SELECT *, median(w) OVER (PARTITION BY doc, page) AS mw, median(h) OVER (PARTITION BY doc, page) AS mh, count(*) OVER (PARTITION BY doc, page) AS cnt FROM g), q AS (SELECT * FROM z WHERE cnt >= 4), {_B.replace('GL_', 'q')},
ib AS (SELECT q.*, min(band) AS band, min(top) AS top FROM q JOIN bands k ON k.doc = q.doc AND k.page = q.page AND q.y + q.h / 2 BETWEEN top - 2 AND bottom + 2 GROUP BY ALL),
f AS (SELECT *, coalesce(CAST(x - (lag(x) OVER t + lag(w) OVER t) > 2.2 * mw AS INT), 1) AS new FROM ib WINDOW t AS (PARTITION BY doc, page, band ORDER BY x, seq)),
sg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc, page, band ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM f)"""
_COLS = """, s0 AS (SELECT doc, page, band, seg, min(x) AS x, any_value(mw) AS mw FROM sg GROUP BY 1, 2, 3, 4),
s1 AS (SELECT *, coalesce(CAST(x - lag(x) OVER o > 3 * mw AS INT), 1) AS new FROM s0 WINDOW o AS (PARTITION BY doc, page ORDER BY x, band, seg)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY x, band, seg ROWS UNBOUNDED PRECEDING) AS chain FROM s1),
s3 AS (SELECT doc, page, chain, count(*) AS n, avg(x) AS c, any_value(mw) AS mw FROM s2 GROUP BY 1, 2, 3),
s4 AS (SELECT doc, page, list([c] ORDER BY c) AS cs, any_value(mw) AS mw FROM (SELECT *, max(n) OVER (PARTITION BY doc, page) AS most FROM s3) WHERE n >= 2 OR most < 2 GROUP BY 1, 2),
cols AS (SELECT doc, page, list_reduce(cs, lambda a, c: CASE WHEN c[1] - a[-1] < 5 * mw THEN list_append(a[1:len(a) - 1], (a[-1] + c[1]) / 2) ELSE list_concat(a, c) END) AS cs FROM s4)"""
_CELLS = _COLS + """, g0 AS (SELECT *, CAST(round((y + h / 2) / (0.7 * mh)) AS BIGINT) AS g FROM sg),
g1 AS (SELECT doc, page, band, seg, g, avg(y + h / 2) AS yc, median(h) AS gh, min(x) AS gx FROM g0 GROUP BY 1, 2, 3, 4, 5),
g2 AS (SELECT *, coalesce(CAST(yc - lag(yc) OVER o > 0.45 * least(gh, lag(gh) OVER o) AS INT), 1) AS new FROM g1 WINDOW o AS (PARTITION BY doc, page, band, seg ORDER BY yc, g)),
g3 AS (SELECT *, sum(new) OVER (PARTITION BY doc, page, band, seg ORDER BY yc, g ROWS UNBOUNDED PRECEDING) AS vline FROM g2),
g4 AS (SELECT g0.doc, g0.page, g0.band, g0.seg, string_agg(label, ' ' ORDER BY vline, gx, g0.g, x, seq) AS text, min(x) AS x0, min(top) AS top FROM g0 JOIN g3 ON g3.doc = g0.doc AND g3.page = g0.page AND g3.band = g0.band AND g3.seg = g0.seg AND g3.g = g0.g GROUP BY 1, 2, 3, 4),
g5 AS (SELECT g4.*, len(cs) AS ncols, len(list_filter(range(1, len(cs)), lambda i: x0 >= (cs[i] + cs[i + 1]) / 2)) AS col FROM g4 JOIN cols ON cols.doc = g4.doc AND cols.page = g4.page),
ce AS (SELECT doc, page, band, col, trim(string_agg(text, ' ' ORDER BY seg, text)) AS text, any_value(ncols) AS ncols, min(top) AS top FROM g5 GROUP BY 1, 2, 3, 4),
tr AS (SELECT doc, page, band, CAST(min(top) AS INT) AS y, count(*) = 1 AND min(col) = 0 AND length(min(text)) > 40 AS "full", any_value(ncols) AS ncols, list(col ORDER BY col) AS at_, list(text ORDER BY col) AS ts FROM ce WHERE text <> '' GROUP BY 1, 2, 3)"""
_L = f"WITH {_G}, l AS (SELECT *, CAST(floor(y / 14) AS INT) AS line FROM g)"
_CODES = ", ".join(f"({n}, '{c}')" for n, c in CODES.items())
_ROWS = rf"""WITH {_G}, codes(number, code) AS (VALUES {_CODES}),
ln AS (SELECT g.*, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS line_seq, code FROM g LEFT JOIN codes ON code = label),
pr AS (SELECT l.doc, l.page, l.line_seq, l.code, count(*) AS n, any_value(m.label) AS raw, any_value(m.y) AS y FROM ln l JOIN ln m ON m.doc = l.doc AND m.page = l.page AND m.x > l.x + 60 AND abs(m.y - l.y) <= 14
  WHERE l.code IS NOT NULL AND regexp_matches(m.label, '^([0-9]{{1,3}}([.][0-9]{{3}})+|[0-9]{{1,5}}),[0-9]{{2}}$') GROUP BY 1, 2, 3, 4),
ra AS (SELECT doc, code, raw, page, y FROM (SELECT *, row_number() OVER (PARTITION BY doc, code ORDER BY page, line_seq) AS k FROM pr WHERE n = 1) WHERE k = 1)"""

ORACLE = {
    "y_bands": f"WITH {_G}, {_B.replace('GL_', 'g')} SELECT * FROM bands",
    "x_segments": _SEGS + " SELECT doc, page, band, seg, min(x) AS x, count(*) AS n FROM sg GROUP BY 1, 2, 3, 4",
    "column_anchors": _SEGS + _COLS + " SELECT doc, page, CAST(i - 1 AS INT) AS col, cs[i] AS center FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cols)",
    "cell_text_rows": _SEGS + _CELLS + """ SELECT doc, page, band, y, "full", list_transform(range(0, ncols), lambda c: coalesce(ts[list_position(at_, c)], '')) AS cells, array_to_string(ts, ' | ') AS text FROM tr""",
    "sub_super_flags": _L + """, m AS (SELECT *, median(h) OVER (PARTITION BY doc, page, line) AS med FROM l),
b AS (SELECT *, median(CASE WHEN h >= 0.85 * med THEN y + h END) OVER (PARTITION BY doc, page, line) AS base, median(CASE WHEN h >= 0.85 * med THEN h END) OVER (PARTITION BY doc, page, line) AS bh FROM m)
SELECT doc, page, line, seq, CASE WHEN h >= 0.85 * med THEN '' WHEN y + h <= base - 0.28 * bh THEN 'sup' WHEN y >= base - 0.62 * bh THEN 'sub' ELSE '' END AS mark FROM b""",
    "glyph_neighbours": _L + """, f AS (SELECT *, lag(label, 1, '-') OVER t AS "left", lead(label, 1, '-') OVER t AS "right", coalesce(CAST(x - (lag(x) OVER t + lag(w) OVER t) > 0.18 * h AS INT), 1) AS new FROM l WINDOW t AS (PARTITION BY doc, page, line ORDER BY seq)),
w AS (SELECT *, sum(new) OVER (PARTITION BY doc, page, line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS word FROM f)
SELECT doc, page, line, seq, "left", "right", CAST(row_number() OVER (PARTITION BY doc, page, line, word ORDER BY seq) - 1 AS INT) AS wpos FROM w""",
    "span_lines": _L + """, f AS (SELECT *, coalesce(CAST(x - max(x + w) OVER (PARTITION BY doc, page, line ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 30 AS INT), 1) AS new FROM l),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc, page, line ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS INT) AS seg FROM f)
SELECT doc, page, line, seg, string_agg(label, ' ' ORDER BY x, seq) AS text, min(x) AS x, round(max(x + w), 3) AS x2 FROM s GROUP BY 1, 2, 3, 4""",
    "row_anchor_pairing": _ROWS + " SELECT * FROM ra",
    "witness_merge": _ROWS + rf""", tl AS (SELECT doc, row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM fulltext WHERE text IS NOT NULL),
tv AS (SELECT doc, code, raw FROM (SELECT doc, regexp_extract(line, '^([^:]+): ', 1) AS code, regexp_extract(line, ': ([0-9][0-9.]*,[0-9]{{2}})', 1) AS raw, row_number() OVER (PARTITION BY doc, regexp_extract(line, '^([^:]+): ', 1), regexp_extract(line, ': ([0-9][0-9.]*,[0-9]{{2}})', 1) <> '' ORDER BY row_id, n) AS k FROM tl) WHERE k = 1 AND raw <> '' AND code IN (SELECT code FROM codes)),
wv AS (SELECT doc, code, 1 AS r, 'boxes' AS src, raw, page FROM ra UNION ALL SELECT doc, code, 2, 'text', raw, 1 FROM tv),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, code ORDER BY r) AS k FROM wv) WHERE k = 1),
dg AS (SELECT fr.doc, fr.code, fr.raw AS value, fr.page, wv.r, wv.src, fr.r AS fr, regexp_replace(fr.raw, '[^0-9]', '', 'g') AS a, regexp_replace(wv.raw, '[^0-9]', '', 'g') AS b FROM fr JOIN wv USING (doc, code))
SELECT doc, code, value, CAST(page AS INT) AS page, count(*) AS witnesses, string_agg(src, ',' ORDER BY r) AS sources FROM dg WHERE r = fr OR a = b OR (length(b) >= 4 AND ends_with(a, b)) GROUP BY 1, 2, 3, 4""",
    "claim_validate": f"""SELECT row_id, attribute AS code, CASE WHEN attribute IN {CURRENCY} THEN 'currency' WHEN attribute = 'Zahl der Arbeitstage' THEN 'enum' END AS datentyp,
  CASE WHEN attribute = 'Zahl der Arbeitstage' THEN trim(value) IN {tuple(DAYS)} OR regexp_replace(value, '[^0-9]', '', 'g') IN {tuple(DAYS)}
       WHEN attribute IN {CURRENCY} THEN coalesce(regexp_matches(trim(value), '^([0-9]{{1,3}}([.][0-9]{{3}})+|[0-9]{{1,5}}),[0-9]{{2}}$'), false) END AS valid FROM claims_in""",
    "claim_texts": f"""WITH codes(number, code) AS (VALUES {_CODES}), t AS (SELECT row_id, coalesce(nullif(regexp_extract(subject, '^([^ ]+)', 1), ''), 'Arbeitgeber unbekannt') || ' — Bescheinigung 2024 — Zeile ' || number || ' (' || code || ')'
  || CASE WHEN number % 2 = 1 THEN ' · Anlage N Zeile ' || number ELSE '' END || ': ' || coalesce(value, '') || ' EUR' AS text FROM claims_in JOIN codes ON attribute = code) SELECT row_id, substr(sha1(text), 1, 16) AS id, text FROM t""",
}
