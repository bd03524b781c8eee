"""Typed claims from text lines: pairing labels with amounts, witnesses, validation.

Lines are (doc, page, line_seq, text, x, y, x2). Order-dependent pairings run per document in Arrow
batches of that document's lines alone.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import MONEY, ROW_LABEL, compact, digits, is_money, row_label

BAND, RIGHT = 14, 60
LINES = "doc string, page int, line_seq int, text string, x double, y double, x2 double"
# Words of a claim's text.
UNKNOWN, SECTION, ROW = "Arbeitgeber unbekannt", "Anlage", "Zeile"
# Fixed value: euros without cents.
EUROS = r"^([0-9]{1,3}([.][0-9]{3})*|[0-9]{1,5})$"
VALUES = "doc string, code string, raw string, page int, y double"


def row_anchors(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, raw, page, y): a numbered label with exactly one amount to the right in its band has
    it; else the single amount within the label's own text. The first label that resolves wins per code.
    ``codes`` is (number, code). Joined on document, page and a strip of the band's height."""
    strip = lambda c: F.floor(F.col(c) / BAND)
    numbered = lines.withColumn("number", row_label("text")).where("number is not null")
    labels = numbered.join(F.broadcast(codes), "number")  # codes: a row per form row
    near = labels.select("doc", "page", "line_seq", "code", F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(F.array(strip("y") - 1, strip("y"), strip("y") + 1)).alias("strip"))
    amounts = lines.where(is_money(F.trim("text"))).select("doc", "page", F.trim("text").alias("raw"), "x", F.col("y").alias("my"), strip("y").alias("strip"))
    pairs = near.join(amounts, ["doc", "page", "strip"]).where((F.col("x") > F.col("lx") + RIGHT) & (F.abs(F.col("my") - F.col("ly")) <= BAND))
    found = pairs.groupBy("doc", "page", "line_seq", "code").agg(F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"), F.first("my").alias("my")).where("n = 1").drop("n")
    own = F.filter(F.split("text", r"\s+"), lambda t: t.rlike(MONEY))
    rows = labels.select("doc", "page", "line_seq", "code", "y", own.alias("own")).join(found, ["doc", "page", "line_seq", "code"], "left")
    raw = F.coalesce("raw", F.when(F.size("own") == 1, F.get("own", F.lit(0))))
    rows = rows.select("doc", "page", "line_seq", "code", raw.alias("raw"), F.coalesce("my", "y").alias("y")).where("raw is not null")
    return rows.groupBy("doc", "code").agg(F.min_by(F.struct("raw", "page", "y"), F.struct("page", "line_seq")).alias("v")).select("doc", "code", "v.raw", "v.page", "v.y")


def column_pairs(lines: pd.DataFrame, codes: dict[int, str], done: set[str], numbers: range = range(3, 8)) -> list[tuple]:
    """Labels of the given rows on the first page that has three of them and three amounts: each, from the
    top, takes the nearest unused amount of the value column that isn't above it. The column holds the
    amounts whose right edge is near the upper median."""
    if all(codes.get(n) in done for n in numbers if n in codes):
        return []
    for page, on in lines.sort_values(["page", "line_seq"]).groupby("page", sort=True):
        number = pd.to_numeric(on.text.str.extract(ROW_LABEL)[0], errors="coerce")
        labels = sorted(zip(on.y[number.isin(numbers)], number.dropna().astype(int)[number.isin(numbers)], strict=True), key=lambda p: p[0])
        plain = on.text.str.strip()
        amounts = on[plain.str.fullmatch(MONEY.strip("^$"))].assign(raw=plain)
        if len(labels) < 3 or len(amounts) < 3:
            continue
        edge = amounts.x2.fillna(amounts.x)
        near = amounts[(edge - sorted(edge)[len(edge) // 2]).abs() <= 40].sort_values("y", kind="stable")
        free, out = list(zip(near.y, near.raw, strict=True)), []
        for ly, n in labels:
            fit = [(abs(my - ly), i) for i, (my, _) in enumerate(free) if ly - 15 <= my and abs(my - ly) <= 220]
            if n in codes and codes[n] not in done and fit:
                my, raw = free.pop(min(fit)[1])
                done.add(codes[n])
                out.append((codes[n], raw, int(page), my))
        return out
    return []


def keyword_pairs(lines: pd.DataFrame, keywords: list[tuple[str, tuple, tuple]], done: set[str]) -> list[tuple]:
    """Labels by keyword in their text without blanks, with exclusions: the amount at least 150 to the
    right that is nearest in height, no amount twice on a page."""
    out = []
    for page, on in lines.sort_values(["page", "line_seq"]).groupby("page", sort=True):
        plain = on.text.str.strip()
        free = [(x, y, t) for x, y, t in zip(on.x, on.y, plain, strict=True) if pd.notna(t) and re.fullmatch(MONEY.strip("^$"), t)]
        flat = on.text.str.lower().str.replace(r"\s+", "", regex=True)
        for code, needed, barred in keywords:
            if code in done or not free:
                continue
            fits = flat.map(lambda t, a=needed, b=barred: all(k in t for k in a) and not any(k in t for k in b))
            for lx, ly in sorted(zip(on.x[fits], on.y[fits], strict=True), key=lambda p: p[1]):
                near = [(abs(y - ly), i) for i, (x, y, _) in enumerate(free) if x >= lx + 150 and -15 <= y - ly <= 70]
                if near:
                    _, y, raw = free.pop(min(near)[1])
                    done.add(code)
                    out.append((code, raw, int(page), y))
                    break
    return out


def greedy_pairs(lines: DataFrame, anchored: DataFrame, codes: dict[int, str], keywords: list[tuple[str, tuple, tuple]]) -> DataFrame:
    """The values of ``anchored`` and, for codes still without one, of column and then keyword pairing.
    A document's labels and amounts, not its other lines, meet in one task."""

    def per_doc(key: tuple, own: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        done = set(have.code)
        out = list(have[["code", "raw", "page", "y"]].itertuples(index=False, name=None))
        out += column_pairs(own, codes, done)
        out += keyword_pairs(own, keywords, done)
        return pd.DataFrame([(key[0], *r) for r in out], columns=["doc", "code", "raw", "page", "y"])

    needed = is_money(F.trim("text")) | row_label("text").isNotNull()
    for _, words, _ in keywords:
        needed = needed | F.contains(compact("text"), F.lit(words[0]))
    lines = lines.where("text is not null and doc is not null").where(needed)  # the rest takes part in no pair
    return lines.groupBy("doc").cogroup(anchored.groupBy("doc")).applyInPandas(per_doc, VALUES)


def first_free(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of a page's pairs (e, c) of places, in order: each e takes its first c that nothing has taken, and which
    took nothing itself; an e that is taken takes nothing."""
    taken, took, out = set(), set(), []
    for e, c in pairs.sort_values(["e", "c"])[["e", "c"]].itertuples(index=False):
        if e not in taken and e not in took and c not in taken and c not in took:
            taken.add(c)
            took.add(e)
            out.append((e, c))
    return pairs[["doc", "page"]].iloc[:1].merge(pd.DataFrame(out, columns=["e", "c"]), how="cross")


def joined_cents(lines: DataFrame) -> DataFrame:
    """Whole euros and two digits of cents to their right on the same line become one amount; the first
    fitting cents by order are used up and leave an empty text. Only the fitting pairs of a page, which are
    found by a join on strips of height, meet in one task. Lines of one place are taken as one."""
    plain = lines.select("doc", "page", "line_seq", F.trim(F.coalesce("text", F.lit(""))).alias("t"), "x", "y", "x2")
    strip = lambda c: F.floor(F.col(c) / 8)
    euros = plain.where(F.col("t").rlike(EUROS)).select("doc", "page", F.col("line_seq").alias("e"), F.col("t").alias("euros"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("x2").alias("ex2"), F.explode(F.array(strip("y") - 1, strip("y"), strip("y") + 1)).alias("strip"))
    cents = plain.where(F.col("t").rlike("^[0-9]{2}$")).select("doc", "page", F.col("line_seq").alias("c"), F.col("t").alias("cents"), "x", "y", strip("y").alias("strip"))
    gap = F.col("x") - F.col("ex2")
    pairs = euros.join(cents, ["doc", "page", "strip"]).where((F.col("e") != F.col("c")) & (F.col("x") > F.col("ex")) & (F.abs(F.col("y") - F.col("ey")) <= 8) & (F.col("ex2").isNull() | ((gap > 0) & (gap <= 130))))
    pairs = pairs.select("doc", "page", "e", "c", "euros", "cents")
    done = pairs.select("doc", "page", "e", "c").groupBy("doc", "page").applyInPandas(first_free, "doc string, page int, e int, c int").join(pairs, ["doc", "page", "e", "c"])
    new = done.select("doc", "page", F.col("e").alias("line_seq"), F.concat_ws(",", "euros", "cents").alias("new")).unionByName(done.select("doc", "page", F.col("c").alias("line_seq"), F.lit("").alias("new")))
    new = new.select(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("line_seq").alias("l"), "new")
    rows = lines.join(new, F.col("doc").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p")) & (F.col("line_seq") == F.col("l")), "left")
    return rows.select("doc", "page", "line_seq", F.coalesce("new", F.trim(F.coalesce("text", F.lit("")))).alias("text"), "x", "y", "x2")


def merged_witnesses(values: DataFrame) -> DataFrame:
    """(doc, code, value, page, y, witnesses, sources) of (doc, witness_rank, source, code, raw, page, y): the
    first witness has the value; a later one confirms it with the same digits, or with four digits or more
    that end the value's."""
    first = values.groupBy("doc", "code").agg(F.min_by(F.struct("raw", "page", "y", "source", "witness_rank"), "witness_rank").alias("f"))
    both = values.select("doc", "code", "witness_rank", "source", digits("raw").alias("d")).join(first, ["doc", "code"])
    same = (F.col("d") == digits("f.raw")) | ((F.length("d") >= 4) & F.endswith(digits("f.raw"), F.col("d")))
    agreed = both.where((F.col("witness_rank") == F.col("f.witness_rank")) | same)
    sources = F.transform(F.array_sort(F.collect_list(F.struct("witness_rank", "source"))), lambda s: s["source"])
    return agreed.groupBy("doc", "code").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("witnesses"), sources.alias("sources")).select(
        "doc", "code", F.col("f.raw").alias("value"), "f.page", "f.y", "witnesses", "sources"
    )


def validated(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """values with the type of their code in ``catalog`` (code, datentyp, enum) and whether they fit it:
    membership by digits or trimmed text, the grammar of amounts, else null."""
    member = F.exists("enum", lambda e: (F.trim(e) == F.trim("value")) | ((digits(e) != "") & (digits(e) == digits("value"))))
    valid = F.when(F.size("enum") > 0, member).when(F.col("datentyp") == "currency", is_money(F.trim("value")))
    return values.join(F.broadcast(catalog), "code", "left").withColumn("valid", valid).drop("enum")  # catalog: a row per form field


def claim_texts(values: DataFrame, labels: DataFrame, title: str, fields: DataFrame | None = None) -> DataFrame:
    """values (employer, year, code, value) with their label, ``text`` and ``id``, the text's hash: employer,
    form and year, label and code, section and row where the field catalog ``fields`` (code, section, row)
    has a section, and the amount. Codes without a label drop out; no employer is 'unknown'."""
    rows = values.join(F.broadcast(labels), "code")  # labels: a row per code
    place = F.lit("")
    if fields is not None:
        rows = rows.join(F.broadcast(fields.select("code", "section", "row")), "code", "left")  # fields: a row per form field
        place = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(f" · {SECTION} "), "section", F.lit(f" {ROW} "), F.coalesce(F.col("row").cast("string"), F.lit("")))).otherwise("")
    text = F.concat(F.coalesce("employer", F.lit(UNKNOWN)), F.lit(f" — {title} "), "year", F.lit(" — "), "label", F.lit(" ("), "code", F.lit(")"), place, F.lit(": "), F.coalesce("value", F.lit("")), F.lit(" EUR"))
    return rows.withColumn("text", text).withColumn("id", F.substring(F.sha1("text"), 1, 16))


def below_anchor(lines: DataFrame, anchor: Column, skip: Column) -> DataFrame:
    """(doc, page, line_seq, found): the next line below each anchor line, at most 130 lower and 260 aside."""
    marks = lines.where(anchor).select("doc", "page", "line_seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.floor(F.col("y") / 130), F.floor(F.col("y") / 130) + 1)).alias("strip"))
    others = lines.where(~skip).select("doc", "page", "text", "x", "y", F.col("line_seq").alias("s"), F.floor(F.col("y") / 130).alias("strip"))
    near = marks.join(others, ["doc", "page", "strip"]).where((F.col("y") > F.col("ay")) & (F.col("y") <= F.col("ay") + 130) & (F.abs(F.col("x") - F.col("ax")) < 260))
    return near.groupBy("doc", "page", "line_seq").agg(F.min_by("text", F.struct("y", "x", "s")).alias("found"))
