"""Queries: claims against evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import verify
from fathomline.session import table


def _atoms(spark: SparkSession, folder: str) -> DataFrame:
    return verify.atomized(*(table(spark, folder, n) for n in ("claims_in", "boxes", "fulltext")))


def atom_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _atoms(spark, folder).select("row_id", "kind", "verdict", "proof_doc", "page", "label_word", "value_word")


def atom_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """Where verified claims stand: the words of the band, and the boxes of label and value."""
    return _atoms(spark, folder).where("verdict = 'verified'").select("row_id", "proof_doc", "line", "label_box", "value_box")


def atom_verdicts_boxes_only(spark: SparkSession, folder: str) -> DataFrame:
    """Without a text register: the boxes' words are the text."""
    return verify.atomized(table(spark, folder, "claims_in"), table(spark, folder, "boxes")).select("row_id", "verdict")


def verdict_report(spark: SparkSession, folder: str) -> DataFrame:
    return _atoms(spark, folder).groupBy("verdict").agg(F.count(F.lit(1)).alias("claims"))


def box_band_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = verify.prepared(table(spark, folder, "claims_in")).where("early is null").select("row_id", "word", F.explode("docs").alias("doc"))
    bands = verify.label_bands(rows, table(spark, folder, "boxes"))
    return bands.groupBy("row_id", "doc", "label_no").agg(F.count(F.lit(1)).alias("boxes"))


QUERIES = {f.__name__: f for f in (atom_verdicts, atom_proofs, atom_verdicts_boxes_only, verdict_report, box_band_join)}


def _prepared() -> str:
    trim = lambda c: rf"nullif(lower(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), '')"
    var = lambda c: f"CASE WHEN trim(coalesce({c}, '')) = '' THEN [] ELSE list_distinct([trim({c}), regexp_replace(trim({c}), '[.]0$', ''), replace(trim({c}), '.', ',')]) END"
    return f"""
c0 AS (SELECT *, coalesce(kind, CASE WHEN regexp_matches(replace(coalesce(value, ''), '.', ''), '^[0-9]+$') THEN 'N' ELSE 'A' END) AS k,
  list_filter(list_transform(coalesce(docs, []), lambda d: {trim('d')}), lambda d: d IS NOT NULL) AS ds, regexp_extract_all(coalesce(attribute, ''), '[A-Za-zÄÖÜäöüß]{{4,}}') AS ws FROM claims_in),
c AS (SELECT row_id, k AS kind, unit, k IN ('N', 'R') AS num,
  CASE WHEN k = 'N' THEN {var('value')} WHEN k = 'R' THEN list_distinct(list_concat({var('value')}, {var('value2')})) WHEN coalesce(value, '') <> '' THEN [value] ELSE [] END AS vs,
  lower(coalesce(list_filter(ws, lambda x: length(x) = list_max(list_transform(ws, lambda y: length(y))))[1], attribute, '')) AS word, ds,
  CASE WHEN k = 'L' THEN 'unverifiable-text' WHEN k IN ('N', 'R') AND trim(coalesce(value, '')) IN ('0', '0.0', '0,0') THEN 'value-null-suspect' WHEN len(ds) = 0 THEN 'no-evidence-doc' END AS early FROM c0),
bx AS (SELECT DISTINCT {trim('doc')} AS doc, page, box_seq, x0, y0, x1, y1, text FROM boxes),
e0 AS (SELECT row_id, word, num, vs, unit, unnest(ds) AS doc, generate_subscripts(ds, 1) AS dp FROM c WHERE early IS NULL),
ex AS (SELECT row_id, doc, any_value(word) AS word, any_value(num) AS num, any_value(vs) AS vs, any_value(unit) AS unit, min(dp) AS dp FROM e0 GROUP BY 1, 2)"""


_TEXT_FULL = r"tx AS (SELECT nullif(lower(regexp_replace(doc, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS doc, lower(max_by(text, (received_at, row_id))) AS text FROM fulltext WHERE text IS NOT NULL GROUP BY 1)"
_TEXT_BOXES = r"tx AS (SELECT nullif(lower(regexp_replace(doc, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '') AS doc, lower(string_agg(text, ' ' ORDER BY box_seq, text)) AS text FROM boxes GROUP BY 1)"
_BANDS = """lb AS (SELECT * FROM (SELECT q.row_id, q.doc, b.page, b.x0 AS lx0, b.x1 AS lx1, b.y0 AS ly0, b.y1 AS ly1, b.text AS label_word, CAST(row_number() OVER (PARTITION BY q.row_id, q.doc ORDER BY box_seq, page, y0, x0, text) AS INT) AS label_no
  FROM WANTED_ q JOIN bx b ON b.doc = q.doc AND contains(lower(b.text), q.word)) WHERE label_no <= 20),
bd AS (SELECT lb.*, b.x0, b.y0, b.x1, b.y1, b.box_seq, b.text FROM lb JOIN bx b ON b.doc = lb.doc AND b.page = lb.page AND b.y0 BETWEEN ly0 - 4 AND ly0 + 30)"""


def _atoms_sql(texts: str) -> str:
    return f"""WITH {_prepared()}, {texts},
ck AS (SELECT ex.*, contains(coalesce(t.text, ''), word) AS label_ok, CASE WHEN num THEN len(list_filter(vs, lambda v: regexp_matches(coalesce(t.text, ''), '(^|[^0-9,.])' || regexp_escape(v) || '([^0-9]|$)'))) > 0
  ELSE len(list_filter(vs, lambda v: contains(coalesce(t.text, ''), lower(v)))) > 0 END AS value_ok FROM ex LEFT JOIN tx t USING (doc)),
wanted AS (SELECT * FROM ck WHERE label_ok AND value_ok), {_BANDS.replace('WANTED_', 'wanted')},
un AS (SELECT bd.*, w.vs, bool_or(coalesce(bd.text = w.unit, false)) OVER (PARTITION BY bd.row_id, bd.doc, label_no) AS unit_here FROM bd JOIN wanted w ON w.row_id = bd.row_id AND w.doc = bd.doc),
ok AS (SELECT * FROM un WHERE len(list_filter(vs, lambda v: regexp_matches(text, '^[^0-9]?' || regexp_escape(v) || '[^0-9]?$'))) > 0
  AND (list_min(list_transform(vs, lambda v: length(v))) > 2 OR unit_here OR (abs(y0 - ly0) < 4 AND x0 >= lx1 AND x0 - lx1 < 250))),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, doc ORDER BY label_no, y0, x0, box_seq) AS n FROM ok) WHERE n = 1),
jd AS (SELECT ck.row_id, ck.doc, dp, page, label_word, pf.text AS value_word, CASE WHEN NOT label_ok THEN 0 WHEN NOT value_ok THEN 1 WHEN page IS NULL THEN 2 ELSE 3 END AS rank FROM ck LEFT JOIN pf ON pf.row_id = ck.row_id AND pf.doc = ck.doc),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rank DESC, dp) AS n FROM jd) WHERE n = 1),
atoms AS (SELECT c.row_id, c.kind, coalesce(early, ['not-in-doc', 'value-not-at-label', 'in-text-not-in-line', 'verified'][be.rank + 1]) AS verdict,
  CASE WHEN be.rank = 3 THEN be.doc END AS proof_doc, be.page, be.label_word, be.value_word FROM c LEFT JOIN be ON be.row_id = c.row_id)"""


ORACLE = {
    "atom_verdicts": _atoms_sql(_TEXT_FULL) + " SELECT * FROM atoms",
    "atom_proofs": _atoms_sql(_TEXT_FULL).replace("jd AS (SELECT ck.row_id, ck.doc, dp, page", "jd AS (SELECT ck.row_id, ck.doc, dp, label_no, lx0, ly0, lx1, ly1, x0, y0, x1, y1, page") + """,
ln AS (SELECT row_id, doc, label_no, substr(string_agg(text, ' ' ORDER BY y0, x0, box_seq, text), 1, 140) AS line FROM bd GROUP BY 1, 2, 3)
SELECT be.row_id, be.doc AS proof_doc, line, [round(lx0, 1), round(ly0, 1), round(lx1, 1), round(ly1, 1)] AS label_box, [round(x0, 1), round(y0, 1), round(x1, 1), round(y1, 1)] AS value_box
FROM be JOIN ln ON ln.row_id = be.row_id AND ln.doc = be.doc AND ln.label_no = be.label_no WHERE be.rank = 3""",
    "atom_verdicts_boxes_only": _atoms_sql(_TEXT_BOXES) + " SELECT row_id, verdict FROM atoms",
    "verdict_report": _atoms_sql(_TEXT_FULL) + " SELECT verdict, count(*) AS claims FROM atoms GROUP BY 1",
    "box_band_join": f"WITH {_prepared()}, {_BANDS.replace('WANTED_', 'ex')} SELECT row_id, doc, label_no, count(*) AS boxes FROM bd GROUP BY 1, 2, 3",
}
