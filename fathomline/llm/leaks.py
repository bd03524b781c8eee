"""Evaluation passages in a corpus: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keys import words

#: Test items that one pass over the corpus looks for; more are looked for in several passes.
ITEMS_AT_ONCE = 20_000


def least_distance(pattern: Sequence, text: Sequence) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text`` (Myers 1999)."""
    size = len(pattern)
    full, high = (1 << size) - 1, 1 << (size - 1)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score, best = full, 0, size, size
    for w in text:
        eq = at.get(w, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(horizontal | up)) & full
        minus = up & horizontal
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        best = min(best, score)
    return best


class Finder:
    """Looks for passages of ``least`` words of the items, with at most ``budget`` word edits; an item of fewer
    words is one passage that must stand as it is.

    An item is cut into pieces so short that any ``least`` consecutive words hold at least budget + 1
    whole ones; so one of them stands in the text unchanged.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int, budget: int) -> None:
        import ahocorasick

        self.items, self.least, self.budget = dict(items), least, budget
        self.size = (least + 1) // (budget + 2)
        if self.size < 1:
            raise ValueError("the budget is too large for passages that short")
        pieces: dict[str, list] = {}
        for item, ws in self.items.items():
            size = self.size if len(ws) >= least else len(ws)
            for p in range(0, len(ws) - size + 1, size):
                pieces.setdefault(" " + " ".join(ws[p : p + size]) + " ", []).append((item, p))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (least distance of a passage, longest run of its words); text: words joined by blanks."""
        found: dict[int, tuple[int, int]] = {}
        if not self.any or not text:
            return found
        line = f" {text} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return found
        ws = text.split(" ")
        seen, word, char = set(), 0, 0
        for end, (length, places) in sorted(hits, key=lambda h: h[0] - h[1][0]):
            begin = end - length + 1
            word += line.count(" ", char, begin)
            char = begin
            for item, p in places:
                if (item, word - p, p) in seen:
                    continue
                own = self.items[item]
                if len(own) < self.least:
                    found[item] = 0, len(own)
                    continue
                a, b = p, p + self.size  # the longest run through this piece
                while a and word - p + a - 1 >= 0 and own[a - 1] == ws[word - p + a - 1]:
                    a -= 1
                while b < len(own) and word - p + b < len(ws) and own[b] == ws[word - p + b]:
                    b += 1
                seen.update((item, word - p, x) for x in range(a - a % self.size, b, self.size))
                best, run = found.get(item, (self.least, 0))
                if best:
                    best = min(best, self.distance(own, ws, p, word, a, b))
                found[item] = best, max(run, b - a)
        return {i: (d, r) for i, (d, r) in found.items() if d <= self.budget}

    def distance(self, own: list[str], ws: list[str], p: int, at: int, a: int, b: int) -> int:
        """The least distance of a passage of the item through its piece at p, found at word ``at``, or one
        beyond the budget. The words a to b around the piece are unchanged; a passage that begins before
        them or ends after them has an edit on that side, so it needn't be compared if that is too many."""
        best = self.budget + 1
        for s in range(max(0, p + self.size - self.least), min(p, len(own) - self.least) + 1):
            edits = (s < a) + (s + self.least > b)
            if edits == 0:
                return 0
            if edits >= best:
                continue
            low = max(0, at - (p - s) - self.budget)
            best = min(best, least_distance(own[s : s + self.least], ws[low : at - (p - s) + self.least + self.budget]))
        return best


def find_leaks(docs: DataFrame, doc_id: str, text: Column, items: DataFrame, item_id: str, item_text: Column, least: int = 12, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, run, words): documents that hold ``least`` consecutive words of an item with
    at most ``budget`` words inserted, deleted or replaced; the least distance by Myers, the longest run of
    unchanged words around a piece, and the words of a passage: ``least``, or all of a shorter item, which
    must stand unchanged.

    Null and empty texts leak nothing; an item that occurs twice under one id is
    taken as its longest text. Documents are read whole, in the task that has them, without a shuffle:
    once for each ITEMS_AT_ONCE items.
    """
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.array_join(words(item_text), " ").alias("w")).where("item_id is not null and w <> ''")
    asked = asked.groupBy("item_id").agg(F.max_by("w", F.length("w")).alias("w"))
    passes = max(1, -(-asked.count() // ITEMS_AT_ONCE))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.array_join(words(text), " ").alias("line"))  # a filter would look for the words twice
    kind = lines.schema["doc_id"].dataType.simpleString()
    out = None
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toArrow() if passes > 1 else asked.toArrow()
        some = [(i, w.split(" ")) for i, w in zip(part["item_id"].to_pylist(), part["w"].to_pylist(), strict=True)]

        def scan(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            finder = Finder(some, least, budget)
            for batch in batches:
                found = [(n, i, d, r, min(least, len(finder.items[i]))) for n, line in enumerate(batch["line"].to_pylist()) for i, (d, r) in finder.find(line).items()]
                if found:
                    n, *values = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(n)), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=["doc_id", "item_id", "distance", "run", "words"])

        now = lines.mapInArrow(scan, f"doc_id {kind}, item_id bigint, distance int, run int, words int")
        out = now if out is None else out.unionByName(now)
    return out
