"""Plumbing shared by operators: rows that a Python function makes of each row, and numbers within groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(rows: DataFrame, keep: list[str], args: list[str], out: dict[str, tuple[str, pa.DataType]], make: Callable[..., list[tuple]]) -> DataFrame:
    """For each row the columns ``keep``, once for each tuple that ``make`` returns for its ``args``, and the
    tuple's values as the columns ``out`` (name -> Spark type, Arrow type). Runs on Arrow batches where the
    rows are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, values in enumerate(zip(*(batch[a].to_pylist() for a in args), strict=True)):
                new = make(*values)
                made += new
                at += [i] * len(new)
            if made:
                index = pa.array(at, pa.int64())
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*made, strict=True), out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[k].take(index) for k in keep), *columns], names=[*keep, *out])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep] + [f"`{k}` {kind}" for k, (kind, _) in out.items()]
    return rows.select(*keep, *(a for a in args if a not in keep)).mapInArrow(run, ", ".join(kinds))


def numbered_within(rows: DataFrame, by: list[str], order: list[str], slice_: Column, name: str) -> DataFrame:
    """rows with ``name``: their place from 0 by ``order`` in their group ``by``. Places are counted in slices
    of a group (``slice_`` must rise with the order) and carried over them, so that a large group is
    numbered by many tasks. Null keys are a group."""
    rows = rows.withColumn("__s", slice_)
    sizes = rows.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(b).alias(f"__{i}") for i, b in enumerate(by)), F.col("__s").alias("__t"), before.alias("__b"))
    on = F.col("__s").eqNullSafe(F.col("__t"))
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "__s").orderBy(*order)) - 1
    rows = rows.withColumn("__p", place).join(sizes, on)
    return rows.withColumn(name, (F.col("__p") + F.col("__b")).cast("int")).drop("__s", "__t", "__p", "__b", *(f"__{i}" for i in range(len(by))))
