"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.keys import plain_key
from fathomline.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a vocabulary file that is sent to the executors at most.
MOST_BYTES = 64 << 20
#: Share of the total that sources which run out may leave unfilled.
SLACK = 0.01
#: Evenly spaced offsets of a source that are tried.
OFFSETS = 32


@lru_cache(maxsize=2)
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: Column, path: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """docs' columns id and source with ``tokens``, the length of the whole text under the byte-level
    BPE whose ranks are at ``path``, a file of the driver that is sent to the executors; null texts have 0."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    content = Path(path).read_bytes()
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(sent.value, pattern)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["source"], pa.array(sizes, pa.int64())], names=["id", "source", "tokens"])

    rows = docs.select("id", "source", text.alias("text"))
    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, source string, tokens bigint")


def largest_total(sources: list[tuple[float, float]], slack: float = SLACK) -> float:
    """Of sources (share, most tokens): the largest total of which those that run out lack ``slack`` together."""
    share = most = total = 0.0
    sources = sorted(sources, key=lambda s: s[1] / s[0])
    for n, (own, tokens) in enumerate(sources):
        share, most, total = share + own, most + tokens, tokens / own
        following = sources[n + 1][1] / sources[n + 1][0] if n + 1 < len(sources) else float("inf")
        if share > slack and most / (share - slack) <= following:
            return max(total, most / (share - slack))
    return total


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate, capped): the expected copies of each
    document of a source, so that the source has its share of ``total`` tokens or, if that is less,
    ``max_repeats`` copies of everything it has.

    By default the total is the largest for which the sources that run out leave at most SLACK of it
    unfilled (``largest_total``); so the others have their share of what is taken up to that. Sources are
    compared in lower case without outer blanks; a source listed twice has the sum of its shares and the
    larger cap; unlisted sources have no row, absent ones no documents and rate 0, and the others keep
    their proportions.
    """
    wanted = targets.select(plain_key("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sized.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    both = materialize(wanted.join(have, "source", "left").fillna(0, ["docs", "tokens"]))
    if total is None:
        rows = both.where("tokens > 0 and target_share > 0").select("target_share", F.col("tokens") * F.col("max_repeats")).collect()  # a row per listed source
        total = largest_total([tuple(r) for r in rows])
    rate = F.when(F.col("tokens") > 0, F.col("target_share") * total / F.col("tokens")).otherwise(0.0)
    cap = F.col("max_repeats").cast("double")
    return both.select("*", F.least(rate, cap).alias("rate"), (rate > cap * (1 + 1e-9)).alias("capped"))


def copies(sized: DataFrame, rates: DataFrame, seed: int = 11) -> DataFrame:
    """(id, source, tokens, copies): systematic sampling within each source.

    Documents stand in order of length, those of a length in order of hash; with the prefix sum of expected
    copies and one random offset per source, a document has a copy for each whole number that its share of
    the line crosses. Neighbours on the line are of like length, so a source's tokens stray little from what
    is expected, and least with the offset taken: the best of OFFSETS from one random start. The sum is carried over slices of a source (of a length and of the
    hash), so a source that holds most rows is summed by many tasks. Ids are taken as unique.
    """
    hashed = F.xxhash64(F.lit(seed), "id")
    rows = sized.where("tokens > 0").join(F.broadcast(rates.where("rate > 0").select("source", "rate")), "source")  # rows: those of the targets
    rows = rows.select("id", "source", "tokens", "rate", hashed.alias("h"), (F.col("tokens") * 64 + F.pmod(F.shiftrightunsigned(hashed, 58), F.lit(64))).alias("slice"))
    slices = rows.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("docs"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("before"))
    unsigned = F.shiftrightunsigned(F.col("h"), 1)
    place = F.row_number().over(Window.partitionBy("source", "slice").orderBy(unsigned, "id")) + F.col("before")
    rows = materialize(rows.join(slices, ["source", "slice"]).select("id", "source", "tokens", "rate", place.alias("place")))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(2**40)) / 2**40
    line = lambda place, offset: F.floor(F.round(place * F.col("rate") + offset, 9))
    crossed = lambda offset: F.least(line(F.col("place"), offset) - line(F.col("place") - 1, offset), F.ceil(F.round("rate", 9)))
    tried = [start + j / OFFSETS for j in range(OFFSETS)]
    taken = rows.groupBy("source", "rate").agg(F.sum("tokens").alias("tokens"), *(F.sum(F.col("tokens") * crossed(o)).alias(f"o{j}") for j, o in enumerate(tried)))
    away = F.array(*(F.struct(F.abs(F.col(f"o{j}") - F.col("tokens") * F.col("rate")).alias("away"), o.alias("offset")) for j, o in enumerate(tried)))
    rows = rows.join(F.broadcast(taken.select("source", F.array_min(away)["offset"].alias("offset"))), "source")  # a row per source
    return rows.select("id", "source", "tokens", crossed(F.col("offset")).cast("int").alias("copies")).where("copies > 0")


def mix(docs: DataFrame, id_col: str, text: Column, source: Column, targets: DataFrame, total: int | None = None, seed: int = 11, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen(id, source, tokens, copies), and per listed source the target share, the
    tokens there and taken, and the share reached. Documents without a token are never chosen."""
    named = docs.select(F.col(id_col).alias("id"), plain_key(source).alias("source"), text.alias("text")).where("source is not null")
    sized = materialize(token_counts(named, F.col("text"), path))
    rates = plan(sized, targets, total)
    chosen = materialize(copies(sized, rates, seed))
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    shares = rates.join(taken, "source", "left").fillna(0, ["taken", "most_copies"])
    whole = F.sum("taken").over(Window.partitionBy())  # a row per listed source
    return chosen, shares.withColumn("share", F.when(whole > 0, F.col("taken") / whole).otherwise(0.0))
