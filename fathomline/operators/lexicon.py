"""Vocabulary, fuzzy correction, held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the longest lexicon words that are found by shortened forms; longer ones are found by length.
LONG = 42


def vocabulary(texts: DataFrame, text: Column, phrases: DataFrame | None = None) -> DataFrame:
    """(word, cnt): words of 2 to 40 letters; whole phrases of (phrase) count as well."""
    long = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.char_length(w).between(2, 40))
    rows = texts.select(F.explode(long).alias("word"))
    if phrases is not None:
        own = phrases.select(F.lower("phrase").alias("word"))
        parts = phrases.select(F.explode(F.filter(F.regexp_extract_all(F.lower("phrase"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.char_length(w).between(2, 40))).alias("word"))
        rows = rows.unionByName(own).unionByName(parts)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def shortened(word: Column) -> Column:
    """A word and all its forms with up to two letters left out. Two words within two edits share one."""
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w)))
    once = lambda w: F.when(F.char_length(w) > 0, F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: without(w, i))).otherwise(F.array().cast("array<string>"))
    ones = once(word)
    return F.array_distinct(F.concat(F.array(word), ones, F.flatten(F.transform(ones, once))))


def corrected(words: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """(word, corrected, distance) of the distinct words: known words and those with other signs than letters
    stay; others become the only lexicon word at the least distance of up to ``most``, if there is one.
    Candidates meet by equal shortened forms, those of more than LONG letters, which have too many forms, by
    lengths within ``most``; so no word meets the whole lexicon."""
    asked = words.where("word is not null").select("word").distinct()
    known = lexicon.select("word").distinct()
    unknown = asked.where(F.col("word").rlike(r"^\p{L}+$")).join(known, "word", "left_anti")
    size = F.char_length("word")
    a = unknown.where(size <= LONG + most).select("word", F.explode(shortened(F.col("word"))).alias("form"))
    b = known.where(size <= LONG).select(F.col("word").alias("other"), F.explode(shortened(F.col("word"))).alias("form"))
    longer = unknown.where(size > LONG - most).select("word", F.explode(F.sequence(size - most, size + most)).alias("size"))
    pairs = a.join(b, "form").select("word", "other").distinct()
    pairs = pairs.unionByName(longer.join(known.where(size > LONG).select(F.col("word").alias("other"), size.alias("size")), "size").select("word", "other"))
    pairs = pairs.withColumn("distance", F.levenshtein("word", "other", most)).where("distance >= 0")
    best = pairs.groupBy("word", "distance").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other"))
    best = best.groupBy("word").agg(F.min_by(F.struct("n", "other", "distance"), "distance").alias("b"))
    rows = asked.join(best, "word", "left")
    only = F.col("b.n") == 1
    return rows.select("word", F.when(only, F.col("b.other")).otherwise(F.col("word")).alias("corrected"), F.when(only, F.col("b.distance")).alias("distance"))


def held_out(docs: DataFrame, doc: str, kind: str, share: float = 0.15) -> DataFrame:
    """(kind, doc): a share of each kind's documents, at least one, by hash; ties of the hash by document.
    Ranks are carried over the hash's first two digits, so a frequent kind is ranked by many tasks."""
    rows = docs.select(F.col(kind).alias("kind"), F.col(doc).alias("doc")).distinct().withColumn("h", F.md5(F.col("doc").cast("string"))).withColumn("slice", F.substring("h", 1, 2))
    slices = rows.groupBy("kind", "slice").agg(F.count(F.lit(1)).alias("n"))
    of_kind = Window.partitionBy("kind")
    before = F.coalesce(F.sum("n").over(of_kind.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("kind").alias("k"), F.col("slice").alias("s"), before.alias("before"), F.greatest(F.lit(1), F.bround(F.sum("n").over(of_kind) * share)).alias("most"))
    rows = rows.join(slices, F.col("kind").eqNullSafe(F.col("k")) & (F.col("slice") == F.col("s")))
    place = F.row_number().over(Window.partitionBy("kind", "slice").orderBy("h", "doc")) + F.col("before")
    return rows.withColumn("place", place).where("place <= most").select(F.col("kind").alias(kind), F.col("doc").alias(doc))


def accuracy(rows: DataFrame, kind: str, truth: str, raw: str, fixed: str) -> DataFrame:
    """(kind, n, raw_accuracy, fixed_accuracy), and over all kinds where kind is null."""
    share = lambda c: F.avg(F.coalesce((F.col(c) == F.col(truth)).cast("int"), F.lit(0)))
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("n"), share(raw).alias("raw_accuracy"), share(fixed).alias("fixed_accuracy"))
