"""Verification of claims against the texts and word boxes of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.keys import plain_key
from fathomline.functions.text import number_variants, quoted, telling_word, text_has

# Verdicts from least to best, the height of a band, the reach to the right of a label.
RANKED = ("not-in-doc", "value-not-at-label", "in-text-not-in-line", "verified")
ABOVE, BELOW, BUCKET, REACH, LABELS = 4, 30, 34, 250, 20


def claim_kind() -> Column:
    """The given kind, else N for a value of digits and points, else A."""
    return F.coalesce("kind", F.when(F.regexp_replace(F.coalesce("value", F.lit("")), "[.]", "").rlike("^[0-9]+$"), "N").otherwise("A"))


def prepared(claims: DataFrame) -> DataFrame:
    """Claims with kind, cleaned distinct docs in order, variants, telling word, and the verdict that
    needs no evidence, if any. Null values have no variants and null docs are none."""
    numeric = F.col("kind").isin("N", "R")
    value = F.coalesce("value", F.lit(""))
    variants = F.when(numeric, F.when(F.col("kind") == "R", F.array_union(number_variants("value"), number_variants("value2"))).otherwise(number_variants("value"))).otherwise(
        F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))
    )
    rows = claims.withColumns({
        "kind": claim_kind(),
        "docs": F.array_distinct(F.filter(F.transform(F.coalesce("docs", F.array().cast("array<string>")), plain_key), lambda d: d.isNotNull())),
    })
    early = F.when(F.col("kind") == "L", "unverifiable-text").when(numeric & F.trim(value).isin("0", "0.0", "0,0"), "value-null-suspect").when(F.size("docs") == 0, "no-evidence-doc")
    return rows.withColumns({"numeric": numeric, "variants": variants, "word": F.lower(F.coalesce(telling_word("attribute"), F.lit(""))), "early": early})


def evidence_texts(fulltext: DataFrame | None, boxes: DataFrame) -> DataFrame:
    """(doc, text) in lower case: the latest text received of a document; without a register, its boxes'
    words in order."""
    if fulltext is not None:
        return fulltext.where("text is not null").groupBy(plain_key("doc").alias("doc")).agg(F.lower(F.max_by("text", F.struct("received_at", "row_id"))).alias("text")).where("doc is not null")
    words = F.transform(F.array_sort(F.collect_list(F.struct("box_seq", "text"))), lambda b: b["text"])
    return boxes.groupBy(plain_key("doc").alias("doc")).agg(F.lower(F.array_join(words, " ")).alias("text")).where("doc is not null")


def label_bands(wanted: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes in the bands of the first LABELS label boxes of each (row_id, doc) with its ``word``: an
    equi-join on document, page and a band of height, with the exact range as rest condition."""
    clean = boxes.select(plain_key("doc").alias("doc"), "page", "box_seq", "x0", "y0", "x1", "y1", "text").where("doc is not null").distinct()
    clean = clean.withColumn("strip", F.floor(F.col("y0") / BUCKET))
    labels = wanted.select("row_id", "doc", "word").join(clean, "doc").where(F.contains(F.lower("text"), F.col("word")))
    nth = F.row_number().over(Window.partitionBy("row_id", "doc").orderBy("box_seq", "page", "y0", "x0", "text"))
    labels = labels.withColumn("label_no", nth).where(F.col("label_no") <= LABELS)
    labels = labels.select("row_id", "doc", "page", "label_no", F.col("text").alias("label_word"), *(F.col(c).alias("l" + c) for c in ("x0", "y0", "x1", "y1")))
    labels = labels.withColumn("strip", F.explode(F.sequence(F.floor((F.col("ly0") - ABOVE) / BUCKET), F.floor((F.col("ly0") + BELOW) / BUCKET))))
    return labels.join(clean, ["doc", "page", "strip"]).where((F.col("y0") >= F.col("ly0") - ABOVE) & (F.col("y0") <= F.col("ly0") + BELOW))


def box_holds(text: Column, variants: Column) -> Column:
    """Whether a box is a variant with at most one non-digit on either side."""
    return F.exists(variants, lambda v: F.rlike(text, F.concat(F.lit("^[^0-9]?"), quoted(v), F.lit("[^0-9]?$"))))


def proofs(wanted: DataFrame, boxes: DataFrame) -> DataFrame:
    """(row_id, doc, page, label_word, value_word, line, label_box, value_box): the first value box in the
    band of the first label that has one. A value of up to two characters also needs its unit in the
    band, or to stand right of the label on its line."""
    band = label_bands(wanted, boxes).join(wanted.select("row_id", "doc", "variants", "unit"), ["row_id", "doc"])
    of_label = Window.partitionBy("row_id", "doc", "label_no")
    right = (F.abs(F.col("y0") - F.col("ly0")) < 4) & (F.col("x0") >= F.col("lx1")) & (F.col("x0") - F.col("lx1") < REACH)
    short = F.array_min(F.transform("variants", F.char_length)) <= 2
    band = band.withColumns({
        "unit_here": F.max(F.coalesce(F.col("text") == F.col("unit"), F.lit(False))).over(of_label),
        "line": F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "box_seq", "text")).over(of_label)), lambda b: b["text"]), " "), 1, 140),
    })
    ok = band.where(box_holds(F.col("text"), F.col("variants")) & (~short | F.col("unit_here") | right))
    box = lambda p: F.array(*(F.round(p + c, 1) for c in ("x0", "y0", "x1", "y1")))
    proof = F.struct("page", "label_word", F.col("text").alias("value_word"), "line", box("l").alias("label_box"), box("").alias("value_box"))
    best = ok.groupBy("row_id", "doc").agg(F.min_by(proof, F.struct("label_no", "y0", "x0", "box_seq")).alias("p"))
    return best.select("row_id", "doc", "p.*")


def atomized(claims: DataFrame, boxes: DataFrame, fulltext: DataFrame | None = None) -> DataFrame:
    """(row_id, kind, verdict, proof_doc, page, label_word, value_word, line, label_box, value_box): each claim's best verdict
    over its documents; the proof is that of the first verified one. row_id is unique."""
    rows = prepared(claims)
    asked = rows.where("early is null").select("row_id", "word", "numeric", "variants", "unit", F.posexplode("docs").alias("doc_pos", "doc"))
    asked = asked.join(evidence_texts(fulltext, boxes), "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    asked = asked.withColumns({"label_ok": F.contains("text", "word"), "value_ok": text_has(F.col("text"), F.col("variants"), F.col("numeric"))}).drop("text")
    found = proofs(asked.where("label_ok and value_ok"), boxes)
    judged = asked.join(found, ["row_id", "doc"], "left")
    rank = F.when(~F.col("label_ok"), 0).when(~F.col("value_ok"), 1).when(F.col("page").isNull(), 2).otherwise(3)
    proof = F.when(rank == 3, F.struct("doc", "page", "label_word", "value_word", "line", "label_box", "value_box"))
    best = judged.groupBy("row_id").agg(F.max(rank).alias("rank"), F.min_by(proof, F.when(rank == 3, F.col("doc_pos"))).alias("proof"))
    verdict = F.coalesce("early", F.element_at(F.array(*map(F.lit, RANKED)), F.col("rank") + 1))
    return rows.join(best, "row_id", "left").select("row_id", "kind", verdict.alias("verdict"), F.col("proof.doc").alias("proof_doc"), "proof.page", "proof.label_word", "proof.value_word", "proof.line", "proof.label_box", "proof.value_box")


def atom_ids(atoms: DataFrame, fields: list[str]) -> DataFrame:
    """atoms with ``atom_id``: the hash of its fields as canonical JSON, keys sorted, nulls kept."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return atoms.withColumn("atom_id", F.substring(F.sha2(body, 256), 1, 16))
