"""Readers and writers: JSON lines, indexes, raw vectors, texts, repositories, versioned containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, doc string, source string, seq int, text string, page int, y int, line_from int, line_to int, reader string"
INDEX = "model string, dims int, count bigint, store string, kind string, reader string, order array<string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file with ``line_seq``; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("line_seq"))
    return lines.select("r.*", "line_seq")


def chunks_by_id(records: DataFrame) -> DataFrame:
    """One record per id, the last of duplicates."""
    rest = [c for c in records.columns if c not in ("id", "line_seq")]
    return records.groupBy("id").agg(F.max_by(F.struct(*rest), "line_seq").alias("r")).select("id", "r.*")


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, model, dims, store) of an index file's order."""
    return spark.read.schema(INDEX).option("multiLine", True).json(path).select(F.posexplode("order").alias("pos", "id"), "model", "dims", "store")


def ordered_chunks(order: DataFrame, chunks: DataFrame, leftovers: bool = False) -> DataFrame:
    """(pos, id, text) of the index order with empty texts for missing chunks; with ``leftovers`` the chunks
    that the order lacks come after it, by id."""
    rows = order.join(chunks.select("id", "text"), "id", "left").select("pos", "id", F.coalesce("text", F.lit("")).alias("text"))
    if not leftovers:
        return rows
    last = order.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    rest = chunks.join(order.select("id"), "id", "left_anti").select("id", F.coalesce("text", F.lit("")).alias("text"))
    rest = rest.repartitionByRange("id").sortWithinPartitions("id")
    return rows.select(F.col("pos").cast("long").alias("pos"), "id", "text").unionByName(rest.select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("pos"), "id", "text"))


#: Bytes of a file of vectors that a task reads at a time.
RANGE = 64 << 20


def raw_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(file, pos, embedding) of row-major float32 files; a .npy file of float32 has its own width. Files of one
    path count on in the order of their names. A file is read in ranges of whole rows by many tasks, so its
    size doesn't matter; only names and lengths go to the driver."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()  # a row per file

    def header(name: str) -> tuple[int, int]:
        """(bytes before the rows, numbers of a row)."""
        system, base = fs.FileSystem.from_uri(name)
        with system.open_input_file(base) as f:
            if f.read(6) != b"\x93NUMPY":
                return 0, dims
            f.seek(0)
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            if fortran or kind != np.dtype("<f4"):
                raise ValueError(f"{name} isn't row-major float32")
            return f.tell(), shape[1]

    jobs, before = [], 0
    for name, length in listed:
        skip, width = header(name)
        rows, step = (length - skip) // (4 * width), max(1, RANGE // (4 * width))
        jobs += [(name, skip + at * 4 * width, min(step, rows - at), width, before + at) for at in range(0, rows, step)]
        before += rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, skip, rows, width, first in zip(*(batch[c].to_pylist() for c in ("file", "skip", "rows", "width", "first")), strict=True):
                system, base = fs.FileSystem.from_uri(name)
                with system.open_input_file(base) as f:
                    f.seek(skip)
                    for at in range(0, rows, 4096):
                        n = min(4096, rows - at)
                        x = np.frombuffer(f.read(n * width * 4), "<f4")
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first + at, first + at + n), pa.int64()), lists], names=["file", "pos", "embedding"])

    ranges = spark.createDataFrame(jobs, "file string, skip bigint, rows bigint, width int, first bigint").repartition(max(1, len(jobs)))
    return ranges.mapInArrow(read, "file string, pos bigint, embedding array<float>")


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source, text) of every file below a folder whose name fits the pattern."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def found_files(spark: SparkSession, folder: str, pattern: str = "**/*.pdf") -> DataFrame:
    """(path) in order; an error if there are none."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).load(folder)
    paths = names.select("path").orderBy("path")
    if paths.isEmpty():
        raise FileNotFoundError(f"no file fits {pattern} in {folder}")
    return paths


#: What a reader of text layers returns per line, and one of blocks per block.
LINE = "doc string, page int, line_seq int, text string, x double, y double, x2 double"
BLOCK = "doc string, seq int, text string"


def _read_with(files: DataFrame, reader, schema: str) -> DataFrame:
    fields = [f.strip().split(" ") for f in schema.split(",")][1:]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = reader(path, content) or []
                if rows:
                    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *columns], names=["doc", *(n for n, _ in fields)])

    return files.select("path", "content").mapInArrow(run, schema)


def read_lines(files: DataFrame, reader) -> DataFrame:
    """LINE rows of files (path, content) by a plug-in: a function of path and bytes that returns (page, line_seq,
    text, x, y, x2) per line, or None without a text layer, which gives no row."""
    return _read_with(files, reader, LINE)


def read_blocks(files: DataFrame, reader) -> DataFrame:
    """BLOCK rows of files by a plug-in that returns the text of each page or block; empty ones are left out."""
    return _read_with(files, lambda path, content: list(enumerate(t.strip() for t in reader(path, content) or [] if t and t.strip())), BLOCK)


def repositories(paths: DataFrame, deepest: int = 11) -> DataFrame:
    """(path, tenant, project, id) of the repositories among file paths: each folder that ends in .git, its
    parents are the hierarchy."""
    rows = paths.select(F.regexp_extract("path", r"^(.*?[.]git)(/|$)", 1).alias("path")).where("path <> ''").distinct()
    rows = rows.select(F.regexp_replace("path", r"[.]git$", "").alias("path")).withColumn("p", F.split("path", "/")).where(F.size("p") <= deepest)
    return rows.select("path", F.col("p")[0].alias("tenant"), F.slice("p", 2, F.greatest(F.size("p") - 2, F.lit(0))).alias("project"), F.element_at("p", -1).alias("id"))


# How names of quantized stores begin.
QUANTIZED = ("turboquant", "tq")


def stored_kind(store: str | None) -> str:
    """Which vectors a store name stands for: 'quantized' or 'f32'."""
    return "quantized" if (store or "").startswith(QUANTIZED) else "f32"


def write_container(chunks: DataFrame, path: str, version: int) -> bool:
    """Append a version of a container's chunks unless their content is that of the latest one; whether it
    was written. The fingerprint is order-free: a count and two sums over row hashes."""
    spark = chunks.sparkSession
    cols = sorted(chunks.columns)

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64(*cols)
        return tuple(df.select(h.alias("h"), F.xxhash64(F.lit(1), *cols).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first())

    from pyspark.errors import AnalysisException

    try:
        old = spark.read.parquet(path)
        latest = old.agg(F.max("version")).first()[0]
    except AnalysisException:
        latest = None
    if latest is not None and mark(old.where(F.col("version") == latest).select(cols)) == mark(chunks.select(cols)):
        return False
    chunks.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    return True


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(chunks: DataFrame, ident: str, kind: str, title: str, model: str | None = None, dims: int = 0, store: str = "none") -> DataFrame:
    """The one-row description of a container."""
    return chunks.agg(
        F.lit(ident).alias("id"), F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(model).cast("string").alias("embed_model"), F.lit(dims).alias("dims"),
        F.countDistinct("doc").alias("doc_count"), F.count(F.lit(1)).alias("chunk_count"), F.lit(store).alias("store"),
    )


def embedded(chunks: DataFrame, id_col: str, text: str, model, dims: int, batch: int = 64) -> DataFrame:
    """(id, embedding) by a plug-in ``model``: a function from a list of texts to rows of numbers, called with
    up to ``batch`` texts; rows are normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = np.asarray(model([t or "" for t in part["text"].to_pylist()]), np.float32).reshape(part.num_rows, dims)
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part["id"], lists], names=["id", "embedding"])

    rows = chunks.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")
