"""Scalar quantization of vectors: rotation, Lloyd-Max levels, codes, decoding, and its measures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.dense import exact_nearest, packed, unit_rows, usable
from fathomline.session import materialize

#: Bins of the histogram that levels are fitted on.
BINS = 1 << 17


@dataclass
class Codebook:
    bits: int
    dims: int
    seed: int
    levels: np.ndarray  # 2^bits, rising
    turn: np.ndarray  # dims x dims, orthogonal

    @property
    def bounds(self) -> np.ndarray:
        return (self.levels[1:] + self.levels[:-1]) / 2


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: QR of Gaussian numbers, signs fixed by the diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_levels(values: np.ndarray, counts: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Lloyd-Max over rising ``values`` that occur ``counts`` times: from evenly spaced levels between the outer
    permilles, each level becomes the mean of its values, an empty one stays; until they hold still."""
    ends = np.cumsum(counts)
    low, high = (values[np.searchsorted(ends, q * (ends[-1] - 1), "right")] for q in (0.001, 0.999))
    levels = np.linspace(low, high, 2**bits)
    for _ in range(rounds):
        code = np.searchsorted((levels[1:] + levels[:-1]) / 2, values)
        count = np.bincount(code, counts, len(levels))
        new = np.sort(np.where(count > 0, np.bincount(code, values * counts, len(levels)) / np.maximum(count, 1), levels))
        if np.allclose(new, levels, atol=1e-6):
            return new
        levels = new
    return levels


def histogram(vectors: DataFrame, vector: Column, dims: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) by bin of the rotated numbers of all usable vectors, which lie between -1 and 1, in one pass."""
    turn = rotation(dims, seed)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                y = (unit_rows(batch["v"], dims) @ turn.T).ravel()
                at = np.clip(((y + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
                count += np.bincount(at, minlength=BINS)
                total += np.bincount(at, y, BINS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some])], names=["bin", "n", "total"])

    rows = vectors.where(usable(vector, dims)).select(vector.cast("array<double>").alias("v")).mapInArrow(binned, "bin int, n bigint, total double")
    got = rows.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow().sort_by("bin")  # BINS rows at most
    n = got["n"].to_numpy().astype(np.float64)
    return got["total"].to_numpy() / n, n


def fit(vectors: DataFrame, id_col: str, vector: Column, dims: int, bits: int = 2, seed: int = 0, bins: tuple[np.ndarray, np.ndarray] | None = None) -> Codebook:
    """A codebook for all usable vectors, fitted on the means of their ``histogram``, which may be given as
    ``bins``; so only numbers in the bin of a bound may count for the neighbouring level."""
    means, counts = bins or histogram(vectors, vector, dims, seed)
    return Codebook(bits, dims, seed, fit_levels(means, counts, bits) if len(means) else np.linspace(-1, 1, 2**bits), rotation(dims, seed))


def codes(vector: Column, bounds: list[float]) -> Column:
    """Levels of a vector's numbers; a number equal to a bound has the lower one."""
    return F.transform(vector, lambda x: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x)))


def encoded(vectors: DataFrame, id_col: str, vector: Column, book: Codebook) -> DataFrame:
    """(id, codes as bytes, norm): unusable vectors have no row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, book.dims)
                code = np.searchsorted(book.bounds, unit_rows(batch["v"], book.dims) @ book.turn.T).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["id"], packed(code), pa.array(np.linalg.norm(raw, axis=1))], names=["id", "codes", "norm"])

    rows = vectors.where(usable(vector, book.dims)).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"))
    return rows.mapInArrow(encode, "id bigint, codes binary, norm double")


def decoded(rows: DataFrame, book: Codebook) -> DataFrame:
    """(id, v): decoded unit vectors, packed in double precision."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, book.dims)
                x = book.levels[code] @ book.turn
                yield pa.RecordBatch.from_arrays([batch["id"], packed(x / np.linalg.norm(x, axis=1, keepdims=True))], names=["id", "v"])

    return rows.mapInArrow(decode, "id bigint, v binary")


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, cosine) of the packed unit vectors of equal id."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(pairs, pa.float64())], names=["id", "cosine"])

    return a.select("id", F.col("v").alias("a")).join(b.select("id", F.col("v").alias("b")), "id").mapInArrow(dot, "id bigint, cosine double")


def score_recall(exact: DataFrame, approximate: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """(queries, score_recall): the true scores of the approximate top-k against those of the exact one, both
    (q_id, id, score); ``true`` (q_id, id, score) has the true scores of the approximate ones."""
    got = approximate if true is None else approximate.select("q_id", "id").join(true, ["q_id", "id"])
    return exact.groupBy("q_id").agg(F.sum("score").alias("e")).join(got.groupBy("q_id").agg(F.sum("score").alias("a")), "q_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), (F.sum(F.coalesce("a", F.lit(0.0))) / F.sum("e")).alias("score_recall")
    )


def true_scores(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """pairs (q_id, id) with the exact cosine as ``score``."""
    both = pairs.select("q_id", "id").join(units.select(F.col("id").alias("q_id"), F.col("v").alias("a")), "q_id").join(units.select("id", F.col("v").alias("b")), "id")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["q_id"], batch["id"], pa.array(got, pa.float64())], names=["q_id", "id", "score"])

    return both.select("q_id", "id", "a", "b").mapInArrow(dot, "q_id bigint, id bigint, score double")


def card(units: DataFrame, rows: DataFrame, book: Codebook, every: int = 20, k: int = 10, exact: DataFrame | None = None) -> DataFrame:
    """One row: bits, vectors, dims, bytes, compression, mean cosine of original and decoded, and the score
    recall of the queries whose id is divisible by ``every``. ``exact`` may have their exact neighbours."""
    back = materialize(decoded(rows, book))
    queries = units.where(F.col("id") % every == 0)
    exact = exact_nearest(units, queries, book.dims, k) if exact is None else exact
    near = materialize(exact_nearest(back, queries, book.dims, k))
    recall = score_recall(exact, near, true_scores(near, units))
    size = similarity(units, back).agg(F.count(F.lit(1)).alias("n_vectors"), F.avg("cosine").alias("cos_fidelity"))
    stored = F.col("n_vectors") * (book.dims * book.bits / 8 + 2) + (book.dims**2) * 2 + 2**book.bits * 4
    both = size.withColumn("one", F.lit(1)).join(recall.withColumn("one", F.lit(1)), "one")  # a row each
    return both.select(F.lit(f"b{book.bits}").alias("level"), F.lit(book.bits).alias("bits"), "n_vectors", F.lit(book.dims).alias("dims"), (F.col("n_vectors") * book.dims * 4 / stored).alias("compression"), "cos_fidelity", F.col("score_recall").alias("score_recall_at_10"))
