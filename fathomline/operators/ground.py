"""Grounding of conversations in passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_of(parts: Column) -> Column:
    """The text parts of a message, joined by blanks; '' without any."""
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), " "), F.lit(""))


def last_user_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text): each conversation's last user message; null texts are ''."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")), "turn").alias("m"))
    return last.select("conv_id", "m.turn", "m.text")


def context_blocks(matches: DataFrame, by: str = "q_id") -> DataFrame:
    """(by, block, passages): numbered passages of (rk, container_id, source, score, text) with where they
    are from."""
    line = F.concat(F.lit("["), F.col("rk").cast("string"), F.lit("] "), F.coalesce("container_id", F.lit("")), F.lit(" / "), F.coalesce("source", F.lit("")), F.lit(" (score "), F.format_string("%.4f", "score"), F.lit(")\n"), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rk", line.alias("line")))), lambda p: p["line"])
    return matches.groupBy(by).agg(F.array_join(ordered, "\n\n").alias("block"), F.count(F.lit(1)).alias("passages"))


def or_nothing_found(queries: DataFrame, blocks: DataFrame, by: str = "q_id") -> DataFrame:
    return queries.select(by).join(blocks, by, "left").select(by, F.coalesce("block", F.lit("No matching passage was found.")).alias("block"), F.coalesce("passages", F.lit(0)).cast("long").alias("passages"))


def grounded(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): all system texts, joined by an empty line, and the grounding text become
    one first system message; the others keep their order and are numbered on. A conversation without
    a block (conv_id, block) stays as it is."""
    found = messages.join(blocks.select("conv_id", "block"), "conv_id", "left")
    untouched = found.where("block is null").select("conv_id", "turn", "role", "text")
    rows = found.where("block is not null")
    system = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))), lambda p: p["text"])
    first = rows.groupBy("conv_id").agg(system.alias("s"), F.first("block").alias("block"))
    first = first.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.array_join(F.concat("s", F.array("block")), "\n\n").alias("text"))
    others = rows.where("role <> 'system'").withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return first.unionByName(others.select("conv_id", "turn", "role", "text")).unionByName(untouched)


def told(queries: DataFrame, blocks: DataFrame, by: str = "q_id", query: str = "q") -> DataFrame:
    """(by, grounded, used_query): how many passages were put in, and the query used as a header has it: percent
    encoded, 400 characters at most."""
    code = F.replace(F.url_encode(F.coalesce(F.col(query), F.lit(""))), F.lit("+"), F.lit("%20"))
    for sign, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        code = F.replace(code, F.lit(sign), F.lit(plain))
    rows = queries.select(by, query).join(blocks.select(by, "passages"), by, "left")
    return rows.select(by, F.coalesce("passages", F.lit(0)).cast("long").alias("grounded"), F.substring(code, 1, 400).alias("used_query"))


def with_model(rows: DataFrame, text: str, model=None, batch: int = 16) -> DataFrame:
    """rows with ``text`` as a plug-in ``model`` rewrites it: a function from a list of texts to as many. Without
    a model, and where it fails or returns nothing, texts stay as they are."""
    if model is None:
        return rows
    from collections.abc import Iterator

    import pyarrow as pa

    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list = []
            old = whole[text].to_pylist()
            for at in range(0, len(old), batch):
                part = old[at : at + batch]
                try:
                    new = list(model(part))
                    new = [b or a for a, b in zip(part, new, strict=True)]
                except Exception:  # a plug-in may be away: the text stays
                    new = part
                out += new
            yield whole.set_column(place, text, pa.array(out, pa.string()))

    return rows.mapInArrow(run, rows.schema)
