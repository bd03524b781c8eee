"""Fusion of rankings, merging of containers, promotion by a reranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(dense: DataFrame, lexical: DataFrame, k: int, c: int = 60) -> DataFrame:
    """(q_id, id, dense_rk, lex_rk, score, rk): reciprocal-rank fusion of two rankings (q_id, id, rk from
    1). Equal scores stand in the order of first sight: by dense rank, then those of the lexical one."""
    both = dense.select("q_id", "id", F.col("rk").alias("dense_rk"), F.lit(None).cast("int").alias("lex_rk")).unionByName(
        lexical.select("q_id", "id", F.lit(None).cast("int").alias("dense_rk"), F.col("rk").alias("lex_rk"))
    )
    both = both.groupBy("q_id", "id").agg(F.min("dense_rk").alias("dense_rk"), F.min("lex_rk").alias("lex_rk"))
    part = lambda rk: F.coalesce(1.0 / (c + F.col(rk)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("dense_rk") + part("lex_rk"), 8))
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rk"), "lex_rk")
    return both.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)


def merged(ranked: DataFrame, k: int, containers: int = 20, by_cosine: bool = False) -> DataFrame:
    """(q_id, container_id, id, score, rk): per-container rankings (q_id, container_id, id, rk, score)
    of the first ``containers`` containers by name as one. ``by_cosine`` keeps the order of a merge
    that sorts lexical results by the dense score they don't have: container by container."""
    first = ranked.select("container_id").distinct().orderBy("container_id").limit(containers)
    few = ranked.join(F.broadcast(first), "container_id").where(F.col("rk") <= k)  # rows: containers
    order = ["container_id", "rk"] if by_cosine else [F.desc("score"), "container_id", "rk"]
    best = Window.partitionBy("q_id").orderBy(*order)
    return few.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select("q_id", "container_id", "id", "score", "rk")


def promoted(ranked: DataFrame, picks: DataFrame, most: int = 3) -> DataFrame:
    """ranked (q_id, id, rk) with ``new_rk``: the first ``most`` distinct picks (q_id, id, pick) that are
    in the ranking come first, the rest keep their order."""
    picks = picks.groupBy("q_id", "id").agg(F.min("pick").alias("pick")).join(ranked.select("q_id", "id"), ["q_id", "id"], "left_semi")
    chosen = picks.withColumn("p", F.row_number().over(Window.partitionBy("q_id").orderBy("pick", "id"))).where(F.col("p") <= most)
    both = ranked.join(chosen.select("q_id", "id", "p"), ["q_id", "id"], "left")
    return both.withColumn("new_rk", F.row_number().over(Window.partitionBy("q_id").orderBy(F.asc_nulls_last("p"), "rk"))).drop("p")


def candidate_lists(ranked: DataFrame, chunks: DataFrame, most: int = 20, cut: int = 240) -> DataFrame:
    """(q_id, candidates): what a reranking model is shown of the ``most`` best of a ranking (q_id, id, rk): per
    line the place from 0, the source if there is one, and the first ``cut`` characters of the text."""
    few = ranked.where(F.col("rk") <= most).join(chunks.select("id", "source", "text"), "id")
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" ("), "source", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), (F.col("rk") - 1).cast("string"), F.lit("]"), source, F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, cut))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rk", line.alias("line")))), lambda p: p["line"])  # most of them at most
    return few.groupBy("q_id").agg(F.array_join(lines, "\n").alias("candidates"))
