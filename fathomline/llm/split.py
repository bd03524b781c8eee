"""Splitting oversized texts: content-defined cuts, snapped to natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH = regex.compile(r"(?<=\S)(?=[^\S\n]*\n\s*\n)")
SENTENCE = regex.compile(r"(?<=(?<!\b\p{L})[.!?…][\"'”“»)\]]*)(?=\s+[^\s\p{Ll}])|(?<=\S)(?=\s*\n)")
WORD = regex.compile(r"(?<=\S)(?=\s)")
WORD_START = regex.compile(r"(?<=\s)(?=\S)")


def rolling_hash(text: str, window: int = 32) -> np.ndarray:
    """A hash of the ``window`` characters that end at each position, by doubling of spans."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span, power = 1, 0xD6E8FEB86659FD93
    while span < window:
        more = h.copy()
        more[span:] += h[:-span] * np.uint64(power)
        h, span, power = more, span * 2, power * power % 2**64
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x9E3779B97F4A7C15)


def cuts(text: str, limit: int = 1400, overlap: int = 100, least: int = 350) -> list[tuple[int, int]]:
    """The (start, end) of each piece.

    From the latest cut, the landmark is the least rolling hash among the ends allowed by ``least``
    and ``limit``; it moves to the nearest paragraph end allowed, else sentence or line end, else word
    end, and stays where there is none. The last piece too has ``least`` characters
    of its own, unless only an end nearer to the text's is natural. A piece begins at the first word start in the ``overlap``
    characters before the latest cut, and that many before it where there is no blank.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    order = rolling_hash(text)
    levels = [np.fromiter((m.start() for m in r.finditer(text)), np.int64) for r in (PARAGRAPH, SENTENCE, WORD)]
    begins = np.fromiter((m.start() for m in WORD_START.finditer(text)), np.int64)
    out, start, cut = [], 0, 0
    while len(text) - start > limit:
        low, high, last = cut + least, min(start + limit, len(text) - least), start + limit
        mark = low + int(np.argmin(order[low - 1 : high]))
        end = mark
        for ends, most in [*((ends, high) for ends in levels), *((ends, last) for ends in levels)]:
            near = ends[np.searchsorted(ends, low) : np.searchsorted(ends, most, "right")]
            if len(near):
                end = int(near[np.argmin(np.abs(near - mark))])
                break
        out.append((start, end))
        cut = end
        k = np.searchsorted(begins, cut - overlap)
        start = int(begins[k]) if k < len(begins) and begins[k] <= cut else cut - overlap
    return [*out, (start, len(text))]


def split_oversized(rows: DataFrame, id_col: str, text: Column, seq: Column, limit: int = 1400, overlap: int = 100) -> DataFrame:
    """(id, piece, seq, start, end, text): the pieces of each text longer than ``limit`` characters.

    Pieces count from 0 and are numbered on from ``seq`` (0 where it is null); ``start`` and ``end``
    are positions in the text, so a piece shares end(before) - start characters with the one before.
    Null texts and those within the limit have none; each of several rows with one id has its own.
    Whole texts are cut in the task that reads them, without a shuffle.
    """
    least = limit // 4
    if not 0 <= overlap < least:
        raise ValueError("the overlap must be less than a quarter of the limit")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, out = [], []
            for i, (text_, seq_) in enumerate(zip(batch["text"].to_pylist(), batch["seq"].to_pylist(), strict=True)):
                for k, (start, end) in enumerate(cuts(text_, limit, overlap, least)):
                    rows_.append(i)
                    out.append((k, seq_ + k, start, end, text_[start:end]))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows_)), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "piece", "seq", "start", "end", "text"])

    long = rows.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(seq.cast("long"), F.lit(0)).alias("seq")).where(F.char_length("text") > limit)
    return long.mapInArrow(pieces, f"id {long.schema['id'].dataType.simpleString()}, piece int, seq bigint, start int, end int, text string")
