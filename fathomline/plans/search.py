"""The search endpoint as one plan: lexical, dense or fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import catalog, dense, fuse, lexical


def search(chunks: DataFrame, queries: DataFrame, k: Column | int | None = 8, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, dims: int = 768) -> DataFrame:
    """(q_id, rk, id, score, mode, source, text): the k best chunks of each query (q_id, q).

    chunks(id, text, source); vectors and query_vectors (id, embedding) switch to fusion. Queries that
    match nothing have no row; texts are cut at 700 characters, scores rounded to 4 digits.
    """
    k = chunks.sparkSession.range(1).select(catalog.clamped_k(k)).first()[0]
    ranked = lexical.bm25_top(chunks, "id", F.col("text"), lexical.query_terms(queries, "q_id", F.col("q")), 100 if vectors is not None else k)
    mode = "lexical"
    if vectors is not None and query_vectors is not None:
        units = dense.with_units(vectors, "id", F.col("embedding"), dims)
        asked = dense.with_units(query_vectors.select((-F.col("id") - 1).alias("id"), "embedding"), "id", F.col("embedding"), dims)
        near = dense.exact_nearest(units, asked, dims, 100).withColumn("q_id", -F.col("q_id") - 1)
        ranked, mode = fuse.fused(near, ranked, k), "hybrid"
    found = ranked.join(chunks.select("id", "source", F.substring("text", 1, 700).alias("text")), "id")
    return found.select("q_id", "rk", "id", F.round("score", 4).alias("score"), F.lit(mode).alias("mode"), "source", "text")
