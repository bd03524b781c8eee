"""Chunking and deduplication of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keys import col
from fathomline.functions.text import COMPANY
from fathomline.operators.rowwise import exploded, numbered_within

WHITE = r"[ \t\n\r\f]"


def trimmed(text: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(col(text), rf"^{WHITE}+|{WHITE}+$", "")


_WHITE = " \t\n\r\f"
_TEXT = ("string", pa.string())
_INT = ("int", pa.int32())


def cut_paragraphs(text: str | None, least: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the runs of non-blank lines."""
    out, run, first = [], [], 0
    lines = (text or "").split("\n")
    for n, line in enumerate([*lines, ""], 1):
        if line.strip(_WHITE):
            first = first if run else n
            run.append(line)
        elif run:
            joined = "\n".join(run).strip(_WHITE)
            if len(joined) > least:
                out.append((first, n - 1, joined))
            run = []
    return out


def paragraphs(docs: DataFrame, id_col: str, text: Column, least: int = 20) -> DataFrame:
    """(id, line_from, line_to, text): runs of non-blank lines, joined and trimmed, longer than ``least``
    characters; lines count from 1. Null texts have none. One pass over a document, in its own row."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    return exploded(rows, ["id"], ["t"], {"line_from": _INT, "line_to": _INT, "text": _TEXT}, lambda t: cut_paragraphs(t, least))


def join_blocks(blocks: list[str] | None, size: int, least: int) -> list[tuple[int, str]]:
    """(number of the first block, text) of blocks joined until ``size`` is reached."""
    out, held, length, first = [], [], 0, 0
    for n, block in enumerate([*(blocks or []), None]):
        if block is not None:
            if not length:
                held, first = [], n
            length += len(block or "") + (2 if length else 0)
            held.append(block or "")
        if length >= size or (block is None and length):
            joined = "\n\n".join(held).strip(_WHITE)
            if len(joined) >= least:
                out.append((first, joined))
            held, length = [], 0
    return out


def greedy(docs: DataFrame, id_col: str, blocks: Column, size: int = 900, least: int = 120, most: int = 1400) -> DataFrame:
    """(id, seq, text_id, text): blocks joined by empty lines until ``size`` is reached. Chunks whose
    trimmed length is below ``least`` drop out, longer ones are cut at ``most``; ``text_id`` is the hash
    before the cut, ``seq`` the number of the first block. Null arrays have none, null blocks are empty."""
    rows = docs.select(F.col(id_col).alias("id"), blocks.alias("b"))
    rows = exploded(rows, ["id"], ["b"], {"seq": _INT, "t": _TEXT}, lambda b: join_blocks(b, size, least))
    return rows.select("id", "seq", F.substring(F.sha2("t", 256), 1, 16).alias("text_id"), F.substring("t", 1, most).alias("text"))


def cut_windows(text: str | None, prefix: str | None, size: int) -> list[tuple[int, str]]:
    """(number, text) of the windows of a text's words; the end of each is found in prefix sums of their lengths."""
    if text is None:
        return []
    prefix = prefix or ""
    if len(prefix) + len(text) <= size:
        return [(0, prefix + text)]
    words = text.split(" ")
    ends = np.cumsum([len(w) + 1 for w in words])
    out, at = [], 0
    while at < len(words):
        if not words[at]:
            at += 1
            continue
        start = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + 1 + size - len(prefix), "right")))
        out.append((len(out), prefix + " ".join(words[at:stop])))
        at = stop
    return out


def word_windows(docs: DataFrame, id_col: str, text: Column, prefix: Column, size: int = 480) -> DataFrame:
    """(id, win, text): the prefix and as many words as ``size`` allows; each window begins with the
    prefix as it is, and a word that is too long has a window of its own. Null texts have none."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), prefix.alias("p"))
    return exploded(rows, ["id"], ["t", "p"], {"win": _INT, "text": _TEXT}, lambda t, p: cut_windows(t, p, size))


def char_windows(docs: DataFrame, id_col: str, text: Column, size: int = 480, step: int = 460) -> DataFrame:
    """(id, start, text): slices of ``size`` characters every ``step``, untrimmed; the last one may lie
    within the one before. Empty texts have none."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).where(F.char_length("t") > 0)
    rows = rows.select("id", "t", F.explode(F.sequence(F.lit(0), F.char_length("t") - 1, F.lit(step))).alias("start"))
    return rows.select("id", "start", F.substring("t", F.col("start") + 1, F.lit(size)).alias("text"))


def keep_row(text: Column, lite: bool = False) -> Column:
    """Whether a row is kept: it has a spaced pipe, 25 characters, or an amount (``lite``: any digit)."""
    amount = text.rlike("[0-9]") if lite else text.rlike(r"(^|[^0-9.])([0-9]{1,3}([.][0-9]{3})+|[0-9]{1,5}),[0-9]{2}([^0-9]|$)")
    return F.coalesce(F.contains(text, F.lit(" | ")) | (F.char_length(text) >= 25) | amount, F.lit(False))


def first_rows(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, text): the rows that are kept, trimmed, the first of equal texts in a document."""
    kept = rows.withColumn(text, trimmed(text)).where(keep_row(F.col(text)))
    return kept.groupBy(doc, text).agg(F.min(order).alias(order)).select(doc, order, text)


def numbered(chunks: DataFrame, doc: str, order: list[str], text: str, least: int = 20, most: int = 1400) -> DataFrame:
    """(doc, *order, seq, text_id, text): chunks whose trimmed text has ``least`` characters, numbered from 0
    in their document, cut at ``most``; ``text_id`` is the hash before the cut. The first of ``order`` is a
    whole number; documents are numbered over slices of it."""
    rows = chunks.select(doc, *order, trimmed(text).alias(text)).where(F.char_length(text) >= least)
    rows = numbered_within(rows, [doc], order, F.floor(F.col(order[0]) / 65_536), "seq")
    return rows.select(doc, *order, "seq", F.substring(F.sha2(text, 256), 1, 16).alias("text_id"), F.substring(text, 1, most).alias(text))


def first_by_content(docs: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per content: the first by ``order``. An aggregate, so that copies meet before the shuffle."""
    rest = [c for c in docs.columns if c not in order]
    firsts = docs.groupBy(F.xxhash64(text).alias("__h"), F.col(text).alias("__t")).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__r"))
    return firsts.select("__r.*").select(docs.columns)


def header_prefix(text: Column) -> Column:
    """The first company name of a first page, white space collapsed, else its first line of more than 8
    characters, else ''; null texts have ''."""
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, COMPANY, 0), r"\s+", " ")), F.lit(""))
    line = F.get(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: F.char_length(x) > 8), F.lit(0))
    return F.coalesce(name, line, F.lit(""))
