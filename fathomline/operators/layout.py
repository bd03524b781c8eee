"""Table reconstruction from glyph boxes (doc, page, seq, label, x, y, w, h): bands, segments, columns, cells.

All steps are windows over a page, which is the unit of layout; a document's size doesn't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import glyphs as glyphs_
from fathomline.operators.rowwise import exploded

PAGE = ["doc", "page"]
STRIP = 32


def sized(glyphs: DataFrame) -> DataFrame:
    """Labelled glyphs with their page's median height ``mh`` and width ``mw``; pages of fewer than four
    glyphs have no table."""
    on = Window.partitionBy(*PAGE)
    rows = glyphs.where("label is not null and label <> ''").withColumns({"n": F.count(F.lit(1)).over(on), "mh": F.percentile("h", F.lit(0.5)).over(on), "mw": F.percentile("w", F.lit(0.5)).over(on)})
    return rows.where("n >= 4").drop("n")


def y_bands(glyphs: DataFrame) -> DataFrame:
    """(doc, page, band, top, bottom): maximal runs of covered whole heights; bands that touch are one."""
    spans = glyphs.select(*PAGE, F.floor("y").alias("a"), F.floor(F.col("y") + F.col("h")).alias("b")).distinct()
    order = Window.partitionBy(*PAGE).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("a") > before + 1).cast("int"), F.lit(1)))
    spans = spans.withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*PAGE, "band").agg(F.min("a").alias("top"), F.max("b").alias("bottom"))


def in_bands(glyphs: DataFrame) -> DataFrame:
    """glyphs with the first band that holds their centre, two units of slack on either side. Joined on the
    page and a strip of height, so that a glyph meets the few bands near it."""
    strip = lambda c: F.floor(c / STRIP)
    bands = y_bands(glyphs).withColumn("strip", F.explode(F.sequence(strip(F.col("top") - 2), strip(F.col("bottom") + 2))))
    centre = F.col("y") + F.col("h") / 2
    pairs = glyphs.withColumn("strip", strip(centre)).join(bands, [*PAGE, "strip"]).where((centre >= F.col("top") - 2) & (centre <= F.col("bottom") + 2))
    first = Window.partitionBy(*PAGE, "seq").orderBy("band")
    return pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "strip")


def x_segments(banded: DataFrame) -> DataFrame:
    """banded glyphs with ``seg``: a new cell begins after a gap of more than 2.2 median widths."""
    order = Window.partitionBy(*PAGE, "band").orderBy("x", "seq")
    gap = F.col("x") - (F.lag("x").over(order) + F.lag("w").over(order))
    rows = banded.withColumn("new", F.coalesce((gap > 2.2 * F.col("mw")).cast("int"), F.lit(1)))
    return rows.withColumn("seg", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def columns(segments: DataFrame) -> DataFrame:
    """(doc, page, centers): segment starts chained while closer than 3 median widths; chains of one are no
    column unless there is no other; centres closer than 5 merge by running average from the left."""
    starts = segments.groupBy(*PAGE, "band", "seg").agg(F.min("x").alias("x"), F.first("mw").alias("mw"))
    order = Window.partitionBy(*PAGE).orderBy("x", "band", "seg")
    starts = starts.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(order) > 3 * F.col("mw")).cast("int"), F.lit(1)))
    starts = starts.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chains = starts.groupBy(*PAGE, "chain").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("c"), F.first("mw").alias("mw"))
    chains = chains.withColumn("most", F.max("n").over(Window.partitionBy(*PAGE))).where("n >= 2 or most < 2")
    pages = chains.groupBy(*PAGE).agg(F.sort_array(F.collect_list("c")).alias("cs"), F.first("mw").alias("mw"))
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        F.slice("cs", 2, F.size("cs")), F.slice("cs", 1, 1),
        lambda a, c: F.when(c - last(a) < 5 * F.col("mw"), F.concat(F.slice(a, 1, F.size(a) - 1), F.array((last(a) + c) / 2))).otherwise(F.concat(a, F.array(c))),
    )
    return pages.select(*PAGE, merged.alias("centers"))


def cells(segments: DataFrame, cols: DataFrame) -> DataFrame:
    """(doc, page, band, col, text, ncols, top): segments by the column of their start; within one, visual
    lines (a new one after 0.45 of the smaller height) and then x; a blank where the gap is over 0.55
    widths or ``wpos`` is 0. What stands together is a line of the text layer (columns ``block`` and
    ``line``, if there are any and the line isn't null), else a grid of 0.7 median heights."""
    grid = F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("a"), F.round((F.col("y") + F.col("h") / 2) / (0.7 * F.col("mh"))).cast("long").alias("b"))
    group = grid
    if {"block", "line"} <= set(segments.columns):
        own = F.struct(F.lit(0).alias("k"), F.coalesce(F.col("block").cast("long"), F.lit(-1)).alias("a"), F.col("line").cast("long").alias("b"))
        group = F.when(F.col("line").isNotNull(), own).otherwise(grid)
    rows = segments.withColumn("g", group)
    groups = rows.groupBy(*PAGE, "band", "seg", "g").agg(F.avg(F.col("y") + F.col("h") / 2).alias("yc"), F.percentile("h", F.lit(0.5)).alias("gh"), F.min("x").alias("x0"))
    order = Window.partitionBy(*PAGE, "band", "seg").orderBy("yc", "g")
    apart = F.col("yc") - F.lag("yc").over(order) > 0.45 * F.least("gh", F.lag("gh").over(order))
    groups = groups.withColumn("new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("vline", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(groups.select(*PAGE, "band", "seg", "g", "vline", F.col("x0").alias("gx")), [*PAGE, "band", "seg", "g"])
    within = Window.partitionBy(*PAGE, "band", "seg", "g").orderBy("x", "seq")
    gap = F.col("x") - (F.lag("x").over(within) + F.lag("w").over(within))
    blank = F.lag("x").over(within).isNull() | (F.coalesce("wpos", F.lit(1)) == 0) | (gap > 0.55 * F.col("mw"))
    rows = rows.withColumn("piece", F.concat(F.when(blank, " ").otherwise(""), "label"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("vline", "gx", "g", "x", "seq", "piece"))), lambda p: p["piece"])
    segs = rows.groupBy(*PAGE, "band", "seg").agg(F.trim(F.array_join(ordered, "")).alias("text"), F.min("x").alias("x0"), F.first("top").alias("top"))
    segs = segs.join(cols, PAGE)
    bounds = F.transform(F.sequence(F.lit(1), F.size("centers")), lambda i: F.when(i < F.size("centers"), (F.get("centers", i - 1) + F.get("centers", i)) / 2).otherwise(F.lit(float("inf"))))
    segs = segs.withColumn("col", F.size(F.filter(bounds, lambda b: F.col("x0") >= b)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), " ")
    return segs.groupBy(*PAGE, "band", "col").agg(joined.alias("text"), F.first(F.size("centers")).alias("ncols"), F.first("top").alias("top"))


def table_rows(glyphs: DataFrame) -> DataFrame:
    """(doc, page, band, y, full, cells, text): rows with the text of each column's cell ('' for none), and
    as one text of the non-empty cells joined by spaced pipes; ``full`` marks a row whose only cell is the
    first column's and longer than 40 characters, ``y`` is where its band begins."""
    segments = x_segments(in_bands(sized(glyphs)))
    found = cells(segments, columns(segments)).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("col", "text")))
    rows = found.groupBy(*PAGE, "band").agg(ordered.alias("cs"), F.first("ncols").alias("ncols"), F.first("top").cast("int").alias("y"))
    full = (F.size("cs") == 1) & (F.get("cs", F.lit(0))["col"] == 0) & (F.char_length(F.get("cs", F.lit(0))["text"]) > 40)
    of_column = F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), lambda c: F.coalesce(F.get(F.filter("cs", lambda x: x["col"] == c), F.lit(0))["text"], F.lit("")))
    return rows.select(*PAGE, "band", "y", full.alias("full"), of_column.alias("cells"), F.array_join(F.transform("cs", lambda c: c["text"]), " | ").alias("text"))


def raised(glyphs: DataFrame) -> DataFrame:
    """(doc, page, block, line, seq, mark): sup or sub for glyphs smaller than 0.85 of their line's median size
    that end well above its base or begin low; the base is that of the glyphs of normal size."""
    line = Window.partitionBy(*PAGE, "block", "line")
    rows = glyphs.withColumn("med", F.percentile("size_pt", F.lit(0.5)).over(line))
    big = F.col("size_pt") >= 0.85 * F.col("med")
    rows = rows.withColumns({"base": F.percentile(F.when(big, F.col("y") + F.col("h")), F.lit(0.5)).over(line), "bh": F.percentile(F.when(big, F.col("h")), F.lit(0.5)).over(line)})
    mark = F.when(big, "").when(F.col("y") + F.col("h") <= F.col("base") - 0.28 * F.col("bh"), "sup").when(F.col("y") >= F.col("base") - 0.62 * F.col("bh"), "sub").otherwise("")
    return rows.select(*PAGE, "block", "line", "seq", mark.alias("mark"))


def neighbours_and_words(glyphs: DataFrame) -> DataFrame:
    """(doc, page, block, line, seq, left, right, wpos): neighbouring labels ('-' at the ends) and the
    position in the word; a gap of more than 0.18 heights begins a word."""
    order = Window.partitionBy(*PAGE, "block", "line").orderBy("seq")
    gap = F.col("x") - (F.lag("x").over(order) + F.lag("w").over(order))
    rows = glyphs.withColumns({"left": F.lag("label", 1, "-").over(order), "right": F.lead("label", 1, "-").over(order), "new": F.coalesce((gap > 0.18 * F.col("h")).cast("int"), F.lit(1))})
    rows = rows.withColumn("word", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wpos = F.row_number().over(Window.partitionBy(*PAGE, "block", "line", "word").orderBy("seq")) - 1
    return rows.select(*PAGE, "block", "line", "seq", "left", "right", wpos.alias("wpos"))


def glyph_vectors(bitmaps: DataFrame) -> DataFrame:
    """(id, fitted, scaled, holes) of bitmaps (id, height, width, pixels as bytes, row by row): see
    ``functions.glyphs``. A null bitmap, or one whose bytes aren't height x width, has no row; one without ink has
    no ``fitted``."""

    def make(height: int | None, width: int | None, pixels: bytes | None) -> list[tuple]:
        if height is None or width is None or pixels is None or len(pixels) != height * width:
            return []
        a = np.frombuffer(pixels, np.uint8).reshape(height, width)
        fit = glyphs_.fitted(a)
        return [(None if fit is None else fit.ravel().tolist(), glyphs_.scaled(a).ravel().tolist(), glyphs_.holes(a))]

    floats = ("array<float>", pa.list_(pa.float32()))
    return exploded(bitmaps, ["id"], ["height", "width", "pixels"], {"fitted": floats, "scaled": floats, "holes": ("int", pa.int32())}, make)


def merged_spans(spans: DataFrame, gap: float = 30) -> DataFrame:
    """(doc, page, line, seg, text, x, x2): spans of a line joined while at most ``gap`` apart."""
    order = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    reach = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("x") - reach > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("seg", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "label"))), lambda s: s["label"]), " ")
    return rows.groupBy(*PAGE, "line", "seg").agg(text.alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x2"))
