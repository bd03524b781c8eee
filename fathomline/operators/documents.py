"""From pages to row chunks: visible glyphs, word starts, header rows, employers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import COMPANY, PLACE, clean_employer, is_money, number_in_name, row_label
from fathomline.operators import chunk, claims, layout

# The anchors of an employer's name, and words that begin other lines of the form.
NAME_ANCHOR = "Name des Arbeitgebers"
BELOW_ANCHOR = r"Anschrift.*Arbeitgebers|Arbeitgeber\s*/\s*Lohnsteuer"
OTHER_LINES = "^(firma|herr|frau|name|steuernummer|anschrift|arbeitgeber)"
HEADER_TITLE = "Datenblatt SNR"
HEAD = 480
#: As PLACE, or before a street.
PLACE_OR_STREET = PLACE.replace("(?=", "(?=[A-ZÄÖÜ][a-zäöü]+str|")


def visible(glyphs: DataFrame) -> DataFrame:
    """Glyphs without those of a box of one pixel or more that has no ink (``ink_sum``); null counts as none."""
    return glyphs.where((F.col("w") < 1) | (F.col("h") < 1) | (F.coalesce("ink_sum", F.lit(0)) >= 1))


def word_starts(glyphs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, seq, wpos): 0 for the leftmost glyph whose centre is in a word's box (one pixel of slack
    aside, two in height), 1 for the others; a later word (word_seq) decides. Glyphs without a word are
    left out. Joined on the page and a strip of height."""
    strip = lambda y: F.floor(y / 16)
    centre = F.col("y") + F.col("h") / 2
    g = glyphs.select("doc", "page", "seq", "x", centre.alias("yc"), strip(centre).alias("strip"))
    w = words.select("doc", "page", "word_seq", "x0", "y0", "x1", "y1", F.explode(F.sequence(strip(F.col("y0") - 2), strip(F.col("y1") + 2))).alias("strip"))
    pairs = g.join(w, ["doc", "page", "strip"]).where((F.col("x") >= F.col("x0") - 1) & (F.col("x") <= F.col("x1") + 1) & (F.col("yc") >= F.col("y0") - 2) & (F.col("yc") <= F.col("y1") + 2))
    nth = F.row_number().over(Window.partitionBy("doc", "page", "word_seq").orderBy("x", "seq"))
    pairs = pairs.withColumn("wpos", (nth > 1).cast("int"))
    return pairs.groupBy("doc", "page", "seq").agg(F.max_by("wpos", "word_seq").alias("wpos"))


def row_chunks(glyphs: DataFrame, files: DataFrame, title: str = HEADER_TITLE) -> DataFrame:
    """(doc, at, win, text), in the order of (at, win): per document a header row with its number and prefix, and its table rows that are
    kept, the first of equal ones, cut into word windows that begin with the prefix. files(doc, source,
    prefix); documents without glyphs have the header alone."""
    pre = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat("prefix", F.lit(" — "))).otherwise("")
    head = files.select("doc", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("win"), F.concat(F.lit(title + " "), number_in_name("source"), F.when(F.coalesce("prefix", F.lit("")) != "", F.concat(F.lit(" · "), "prefix")).otherwise("")).alias("text"))
    rows = layout.table_rows(glyphs).withColumn("at", F.col("page").cast("long") * 100_000 + F.col("band")).where(chunk.keep_row(F.col("text")))
    rows = rows.groupBy("doc", "text").agg(F.min("at").alias("at")).join(files.select("doc", pre.alias("pre")), "doc")
    cut = chunk.word_windows(rows.withColumn("key", F.struct("doc", "at")), "key", F.col("text"), F.col("pre")).select("id.doc", "id.at", "win", "text")
    return head.unionByName(cut).select("doc", "at", "win", "text")


def table_witness(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, raw, page, y) of table rows (doc, page, y, cells): the first amount of a row belongs to the
    first numbered label in it; the first row wins per code."""
    cells = F.filter("cells", lambda c: c != "")
    found = rows.select("doc", "page", "y", F.get(F.filter(F.transform(cells, lambda c: F.trim(c)), is_money), F.lit(0)).alias("raw"), F.get(F.filter(F.transform(cells, row_label), lambda n: n.isNotNull()), F.lit(0)).alias("number"))
    found = found.where("raw is not null and number is not null").join(F.broadcast(codes), "number")  # codes: a row per form row
    return found.groupBy("doc", "code").agg(F.min(F.struct("page", "y", "raw")).alias("v")).select("doc", "code", "v.raw", "v.page", "v.y")


def first_company(lines: DataFrame, span: int = 9) -> DataFrame:
    """(doc, firm): the first company name in a document's lines, which may run over lines that follow each
    other. Each line is read with the ``span`` - 1 non-blank ones after it, more than a name can have words,
    and has the name that begins in it; so no document's text is put together."""
    order = Window.partitionBy("doc").orderBy("page", "line_seq")
    rows = lines.where(F.trim("text") != "")
    ahead = rows.withColumn("block", F.concat_ws("\n", "text", *(F.lead("text", k).over(order) for k in range(1, span))))
    starts = F.regexp_instr("block", F.lit(COMPANY))
    rows = ahead.where((starts > 0) & (starts <= F.char_length("text"))).select("doc", F.struct("page", "line_seq").alias("o"), F.regexp_extract("block", COMPANY, 0).alias("firm"))
    return rows.groupBy("doc").agg(F.min_by("firm", "o").alias("firm"))


def employers(lines: DataFrame) -> DataFrame:
    """(doc, employer): what follows the name anchor on its line, or the line below an address anchor,
    whichever is first; else the first name before an address in the head of page 1, else the first
    company; null if there is none, or if the one found is no name."""
    text = F.trim("text")
    sane = (F.char_length(text) >= 3) & ~text.rlike("^[0-9]") & ~F.lower(text).rlike(OTHER_LINES)
    order = F.struct("page", "y", "x", "line_seq")
    after = F.btrim(F.get(F.split("text", NAME_ANCHOR, 2), F.lit(1)), F.lit(" |:"))
    named = lines.where(F.char_length(after) > 3).select("doc", order.alias("o"), F.lit(0).alias("turn"), after.alias("name"))
    below = claims.below_anchor(lines.where("text is not null"), F.col("text").rlike(BELOW_ANCHOR), ~sane)
    below = below.join(lines.select("doc", "page", "line_seq", order.alias("o")), ["doc", "page", "line_seq"]).select("doc", "o", F.lit(1).alias("turn"), F.trim("found").alias("name"))
    first = named.unionByName(below).groupBy("doc").agg(F.min_by("name", F.struct("o", "turn")).alias("anchored"))
    cut = F.split(F.substring(text, 4, 1 << 30), PLACE_OR_STREET, 2)  # a name has 3 characters or more
    address = F.concat(F.substring(text, 1, 3), cut[0])
    named_head = (F.size(cut) == 2) & F.char_length(address).between(3, 60) & ~F.lower(address).rlike(OTHER_LINES)
    head = lines.where((F.col("page") == 1) & (F.col("y") < HEAD) & named_head).groupBy("doc").agg(F.min_by(address, order).alias("head"))
    rows = lines.select("doc").distinct().join(first, "doc", "left").join(head, "doc", "left").join(first_company(lines), "doc", "left")
    return rows.select("doc", clean_employer(F.coalesce("anchored", "head", "firm")).alias("employer"))


def summary(texts: DataFrame, values: DataFrame, wage_code: str) -> DataFrame:
    """One row (docs, scans, claims, wage_docs): documents, those without text, claims, and documents with a
    value of ``wage_code``. texts(doc, text) may have several rows of a document."""
    per = texts.groupBy("doc").agg(F.max((F.trim(F.coalesce("text", F.lit(""))) != "").cast("int")).alias("read"))
    a = per.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("read") == 0).alias("scans")).withColumn("one", F.lit(1))
    b = values.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct(F.when(F.col("code") == wage_code, F.col("doc"))).alias("wage_docs")).withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one")  # a row each


def by_name(rows: DataFrame, name: Column) -> DataFrame:
    """Rows in the order of a language's names."""
    return rows.orderBy(F.collate(name, "UNICODE_CI"), name)
