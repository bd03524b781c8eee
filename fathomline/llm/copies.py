"""Copies hidden by formatting: range-partitioned external sort of canonical records, then a scan of
adjacent runs that compares full keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keys import folded
from fathomline.session import materialize

FIELD = "\x01"
SEPARATORS = r"[|;\t\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]"


def _squashed(text: Column) -> Column:
    """Letters and numbers in sequence; a blank stays only between two numbers, FIELD stays."""
    text = F.regexp_replace(folded(text), r"[.,](?:(?!\p{Nd})|(?<!\p{Nd}.))", " ")
    text = F.regexp_replace(text, rf"[^\p{{L}}\p{{Nd}}.,{FIELD}]+", " ")
    return F.regexp_replace(text, r" (?:(?!\p{Nd})|(?<!\p{Nd} ))", "")


def canonical(text: Column, fields: Column) -> Column:
    """The canonical form of a text; where ``fields`` is true, that of its sorted non-empty fields.

    Null and contentless texts give null. A row of fields is a flat JSON object, or is cut at pipes,
    semicolons, tabs and line breaks; one that only looks like JSON is cut like any other.
    """
    text = F.when(F.contains(text, F.lit(FIELD)), F.translate(text, FIELD, " ")).otherwise(text)
    pairs = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    row = F.coalesce(
        F.when(text.rlike(r"^\s*\{"), F.array_join(F.transform(pairs, lambda p: F.translate(p, FIELD, " ")), FIELD)),
        F.regexp_replace(text, SEPARATORS, FIELD),
    )
    squashed = _squashed(F.when(fields, row).otherwise(text))
    ordered = F.array_join(F.array_sort(F.filter(F.split(squashed, FIELD), lambda f: f != "")), FIELD)
    return F.nullif(F.when(fields, ordered).otherwise(squashed), F.lit(""))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted partition.

    Yields copies (kind 0: head, id), runs (kind 1: head, n), and runs that may go on in another
    partition (kind 2: with their key), which are those of the partition's first and last hash.
    """
    part = TaskContext.get().partitionId()
    first, held, kind_of_id = None, [], None  # held: [key, hash, head, n] of the runs of the latest hash

    def out(kind: int, head, ids=None, n=None, key=None) -> pa.RecordBatch:
        size = len(head)
        columns = [
            pa.array([kind] * size, pa.int8()), pa.array([part] * size, pa.int32()), pa.nulls(size, pa.string()) if key is None else key,
            head, pa.nulls(size, kind_of_id) if ids is None else ids, pa.nulls(size, pa.int64()) if n is None else n,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "key", "head", "id", "n"])

    def settled(runs: list) -> pa.RecordBatch:
        key, _, head, n = zip(*runs, strict=True)
        return out(2, pa.array(head, kind_of_id), None, pa.array(n, pa.int64()), pa.array(key, pa.string()))

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        h1, h2, key, ids = (batch[c] for c in ("h1", "h2", "key", "id"))
        kind_of_id = ids.type
        begins = np.ones(size, bool)
        begins[1:] = pc.not_equal(key.slice(1), key.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        goes_on = bool(held) and held[-1][0] == key[0].as_py()
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, size))
        heads = ids.take(pa.array(starts))
        if goes_on:
            heads = pa.concat_arrays([pa.array([held[-1][2]], kind_of_id), heads.slice(1)])
            begins[0] = False
        copies = pa.array(~begins)
        row_heads = heads.take(pa.array(np.repeat(np.arange(len(starts)), sizes))).filter(copies)
        if len(row_heads):
            yield out(0, row_heads, ids.filter(copies))
        a, b = (x.to_numpy(zero_copy_only=False)[starts] for x in (h1, h2))
        first = first or (a[0], b[0])
        watched = ((a == first[0]) & (b == first[1])) | ((a == a[-1]) & (b == b[-1]))
        watched[0] = True
        inner = np.flatnonzero(~watched)
        if len(inner):
            yield out(1, heads.take(pa.array(inner)), None, pa.array(sizes[inner], pa.int64()))
        for k in np.flatnonzero(watched):
            if k == 0 and goes_on:
                held[-1][3] += int(sizes[0])
                continue
            hash_ = (a[k], b[k])
            if held and held[-1][1] != hash_:
                yield settled(held)
                held = []
            held.append([key[int(starts[k])].as_py(), hash_, heads[int(k)].as_py(), int(sizes[k])])
    if held:
        yield settled(held)


def collapse_copies(rows: DataFrame, id_col: str, text: Column, fields: Column) -> tuple[DataFrame, DataFrame]:
    """``(records, copies)``: records(id, copies), one row per content with its number of copies, and
    copies(first_id, copy_id), one row per copy that isn't the lowest id of its group.

    The sort's order is (hash, hash, id), so that the copies of one content, however many, spread
    over as many range partitions as their size needs; runs that cross partitions are joined by a
    small table (a run is noted with its key where an Arrow batch or a partition begins or ends). Null and contentless texts are left
    out; an id may occur twice and then counts twice; other columns don't matter.
    """
    key = F.concat(F.when(fields, "f").otherwise("t"), canonical(text, fields))
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key"))
    keyed = materialize(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "key", "id"))  # the range sampling reads it too
    keyed = keyed.where("key is not null and id is not null")  # here, else the filter would compute the keys once more
    id_type = keyed.schema["id"].dataType.simpleString()
    scanned = materialize(
        keyed.repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "key", "id").mapInArrow(_scan, f"kind tinyint, part int, key string, head {id_type}, id {id_type}, n bigint")
    )
    edges = scanned.where("kind = 2").select("part", "key", "head", "n")
    whole = edges.groupBy("key").agg(F.min("head").alias("first"), F.sum("n").alias("n"))
    moved = edges.join(whole.select("key", "first"), "key").where("head <> first").select(F.col("head").alias("part_head"), "first")
    moved = F.broadcast(moved)  # at most one row per partition and its edge contents: only runs that cross partitions
    copies = (
        scanned.where("kind = 0").join(moved, F.col("head") == F.col("part_head"), "left")
        .select(F.coalesce("first", "head").alias("first_id"), F.col("id").alias("copy_id"))
        .unionByName(moved.select(F.col("first").alias("first_id"), F.col("part_head").alias("copy_id")))
    )
    records = scanned.where("kind = 1").select(F.col("head").alias("id"), F.col("n").alias("copies")).unionByName(whole.select(F.col("first").alias("id"), F.col("n").alias("copies")))
    return records, copies
