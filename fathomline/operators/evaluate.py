"""Evaluation of a ranking against gold questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import digits


def with_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (q_id, id, rk, source, text) with ``hit``: the source names the gold document and the digits
    of the text hold those of the value. A value without digits is never hit."""
    wanted = digits("value")
    asked = gold.select("q_id", F.col("doc").alias("gold_doc"), wanted.alias("wanted"))
    hit = F.contains("source", "gold_doc") & (F.col("wanted") != "") & F.contains(digits("text"), F.col("wanted"))
    return ranked.join(asked, "q_id").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("gold_doc", "wanted")


def answerable(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id): questions that some chunk answers. A source's document number joins it to the gold
    document, so that no question meets all chunks; the predicate is then that of ``with_hits``."""
    keyed = chunks.select("source", digits("text").alias("d"), F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"[A-Z]+-[0-9]+"), F.lit(0)))).alias("doc"))
    asked = gold.select("q_id", "doc", digits("value").alias("wanted")).where("wanted <> ''")
    return asked.join(keyed, "doc").where(F.contains("d", "wanted")).select("q_id").distinct()


def per_question(hits: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """(q_id, hit1, hit3, oracle, diagnosis, sources): the diagnosis of a question not hit in the top 3 is 'no
    atom' if no chunk answers it, else 'rank > 3'; null where hit. sources are those of its top 3."""
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", "source")))), lambda s: F.coalesce(s["source"], F.lit("")))
    best = hits.groupBy("q_id").agg(top.alias("sources"), F.max((F.col("hit") & (F.col("rk") <= 1)).cast("int")).alias("hit1"), F.max((F.col("hit") & (F.col("rk") <= 3)).cast("int")).alias("hit3"))
    rows = gold.select("q_id").join(best, "q_id", "left").join(found.withColumn("oracle", F.lit(1)), "q_id", "left").fillna(0, ["hit1", "hit3", "oracle"])
    return rows.withColumn("diagnosis", F.when(F.col("hit3") == 1, None).when(F.col("oracle") == 0, "no atom").otherwise("rank > 3"))


def report(questions: DataFrame) -> DataFrame:
    """(questions, recall1, recall3, oracle)."""
    return questions.agg(F.count(F.lit(1)).alias("questions"), F.avg("hit1").alias("recall1"), F.avg("hit3").alias("recall3"), F.avg("oracle").alias("oracle"))
