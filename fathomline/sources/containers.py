"""Containers on disk: chunks, order, raw vectors, quantized stores, atoms, claims, and the way back.

A container is a folder; each of its files is a folder of part files in order, so that no task writes or
reads it alone. Small descriptions are one row of JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.catalog import OVERLAY
from fathomline.operators.codec import Codebook, decoded, encoded
from fathomline.operators.dense import unpacked, usable
from fathomline.session import materialize
from fathomline.sources.io import manifest, raw_vectors, stored_kind

CHUNKS, ORDER, INDEX, VECTORS, STORE, MANIFEST = "data/chunks.jsonl", ".brain/order", ".brain/index.json", ".brain/vectors.f32", ".brain/store", "container.json"
ATOMS, REPORT = "data/atoms.jsonl", "report.json"


def _ordered(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartitionByRange(by).sortWithinPartitions(by)


def write_raw_vectors(rows: DataFrame, path: str, dims: int) -> int:
    """Write rows (pos, embedding) as little-endian float32 in the order of ``pos``, one file per partition,
    and return their number. A vector that isn't usable is written as zeros, so that places stay. A task
    writes under a name of its attempt and then renames, so a repeated task leaves one file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (system, base) = TaskContext.get(), fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        name, n = f"part-{task.partitionId():05d}.f32", 0
        with system.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}") as out:
            for batch in batches:
                x = batch["v"].flatten().to_numpy(zero_copy_only=False).astype("<f4")
                out.write(x.tobytes())
                n += batch.num_rows
        system.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    v = F.when(usable(F.col("embedding"), dims), F.col("embedding").cast("array<float>")).otherwise(zeros)
    return _ordered(rows.select("pos", v.alias("v")), "pos").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_container_files(chunks: DataFrame, path: str, ident: str, kind: str, title: str, model: str | None = None, dims: int = 0, store: str = "none", vectors: DataFrame | None = None) -> None:
    """Write a build: chunks with ``pos`` and ``id`` as JSON lines in order, their order, the index and manifest of
    one row each, and the raw vectors (pos, embedding), if any. Equal ids stay apart by their place."""
    _ordered(chunks, "pos").drop("pos").write.mode("overwrite").json(f"{path}/{CHUNKS}")
    _ordered(chunks.select("pos", "id"), "pos").write.mode("overwrite").json(f"{path}/{ORDER}")
    about = chunks.agg(F.lit(model).cast("string").alias("model"), F.lit(dims).alias("dims"), F.count(F.lit(1)).alias("count"), F.lit(store).alias("store"), F.lit(kind).alias("kind"))
    about.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{INDEX}")
    manifest(chunks, ident, kind, title, model, dims, store).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{MANIFEST}")
    if vectors is not None:
        write_raw_vectors(vectors, f"{path}/{VECTORS}", dims)


def write_claims_container(claims: DataFrame, path: str, ident: str, title: str) -> None:
    """Claims (pos, id, text and more) as a container without vectors; duplicates stay."""
    write_container_files(claims, path, ident, "claims", title)


def write_atoms(atoms: DataFrame, path: str, ident: str, title: str, method: str) -> None:
    """Atoms as JSON lines, and a report and manifest with the number of atoms per verdict."""
    atoms.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{ATOMS}")
    per = atoms.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))  # a row per verdict
    verdicts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts")
    per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), verdicts, F.lit(method).alias("method")).write.mode("overwrite").json(f"{path}/{REPORT}")
    per.agg(F.lit(ident).alias("id"), F.lit("atoms").alias("type"), F.lit(title).alias("title"), F.coalesce(F.sum("n"), F.lit(0)).alias("atom_count"), verdicts).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def write_store(vectors: DataFrame, id_col: str, vector: Column, book: Codebook, path: str) -> None:
    """Write the codes and norms of vectors, and the codebook, as a compressed store."""
    spark = vectors.sparkSession
    encoded(vectors, id_col, vector, book).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/codes")
    row = (book.bits, book.dims, book.seed, [float(x) for x in book.levels], [float(x) for x in book.turn.astype(np.float16).ravel()])
    spark.createDataFrame([row], "bits int, dims int, seed int, levels array<float>, turn array<float>").write.mode("overwrite").parquet(f"{path}/book")


def read_store(spark: SparkSession, path: str) -> tuple[Codebook, DataFrame]:
    """The codebook of a store and its rows (id, codes, norm)."""
    b = spark.read.parquet(f"{path}/book").first()
    return Codebook(b.bits, b.dims, b.seed, np.array(b.levels), np.array(b.turn).reshape(b.dims, b.dims)), spark.read.parquet(f"{path}/codes")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding): the decoded unit vectors of a store in half precision. Each is scaled by its norm
    before it is made one, as it was stored; that changes nothing unless the norm is 0, which gives zeros."""
    book, rows = read_store(spark, path)
    dims = book.dims

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch["v"], np.float64) * (batch["norm"].to_numpy()[:, None] > 0)
                flat = pa.array(x.astype(np.float16).astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), flat)], names=["id", "embedding"])

    return decoded(rows, book).join(rows.select("id", "norm"), "id").mapInArrow(half, "id bigint, embedding array<float>")


def store_info(spark: SparkSession, path: str) -> DataFrame:
    """(vectors, dims, bits, codebook, bytes) of a store, of its metadata alone: nothing is decoded."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length").alias("bytes"))
    n = spark.read.parquet(f"{path}/codes").agg(F.count(F.lit(1)).alias("vectors"))
    book = spark.read.parquet(f"{path}/book").select("dims", "bits", F.size("levels").alias("codebook"))
    return n.join(book).join(size).select("vectors", "dims", "bits", "codebook", "bytes")  # a row each


def container_vectors(spark: SparkSession, path: str, store: str | None, dims: int) -> DataFrame:
    """(pos, embedding) of a container: of its quantized store if the index names one that is there, else the raw
    vectors, else none."""
    empty = spark.createDataFrame([], "pos bigint, embedding array<float>")
    if stored_kind(store) == "quantized":
        try:
            return load_store(spark, f"{path}/{STORE}").withColumnRenamed("id", "pos")
        except AnalysisException:
            pass
    try:
        return raw_vectors(spark, f"{path}/{VECTORS}", dims).select("pos", "embedding")
    except AnalysisException:
        return empty


def field_catalog(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(code, datentyp, enum, section, row) of a field catalog, a JSON object of codes; None if there is none or
    it can't be read, which only drops what it would add."""
    if path is None:
        return None
    try:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<datentyp:string,enum:array<array<string>>,anlage:string,zeile:string>>").alias("m"))
        rows = text.select(F.explode("m").alias("code", "f")).select("code", "f.datentyp", F.transform("f.enum", lambda e: e[0]).alias("enum"), F.col("f.anlage").alias("section"), F.col("f.zeile").alias("row"))
        return None if rows.isEmpty() else rows
    except AnalysisException:
        return None


def save_overlay(overlay: DataFrame, path: str) -> None:
    """Write what was told of tenants, projects and containers in place of what was there; it may have been read
    from there."""
    materialize(overlay).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)  # a row per name told


def load_overlay(spark: SparkSession, path: str) -> DataFrame:
    """What was told; nothing if nothing was written."""
    try:
        return spark.read.schema(OVERLAY).json(path)
    except AnalysisException:
        return spark.createDataFrame([], OVERLAY)
