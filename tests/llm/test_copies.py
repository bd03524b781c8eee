import pytest
from pyspark.sql import functions as F

pytest.importorskip("fathomline.llm")

from fathomline.llm.copies import canonical, collapse_copies  # noqa: E402

SCHEMA = "row_id bigint, text string, reader string, h1 int, key string, id string"


def found(spark, data):
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in data], SCHEMA)
    records, copies = collapse_copies(df, "row_id", F.col("text"), F.coalesce(F.col("reader") == "glyph", F.lit(False)))
    return sorted(map(tuple, records.collect())), sorted(map(tuple, copies.collect()))


def test_what_counts(spark):
    data = [
        (1, "A-B straße 12,5", "text"), (2, "ab STRASSE 12,5.", None), (3, "ab strasse 125", "text"), (4, "ab strasse 12 5", "block"),
        (5, "AB Straße 12  5", "text"), (6, "| | |", "text"), (7, None, "text"), (8, "", "glyph"), (9, "ab strasse 12..5", "text"),
    ]
    records, copies = found(spark, data)
    assert copies == [(1, 2), (4, 5), (4, 9)]
    assert records == [(1, 2), (3, 1), (4, 3)]


def test_fields_in_any_order(spark):
    data = [
        (1, "A: 1 | B: 2,5", "glyph"), (2, "B: 2,5; a: 1;;", "glyph"), (3, '{"B": "2,5", "A": "1"}', "glyph"), (4, "A: 1 B: 2,5", "text"),
        (5, "B 2,5\n A 1\r\n", "glyph"), (6, "A: 1\tA: 1\tB: 2,5", "glyph"), (7, "A: 2 | B: 1,5", "glyph"), (8, "{ A: 1 | B: 2,5", "glyph"),
    ]
    records, copies = found(spark, data)
    assert copies == [(1, 2), (1, 3), (1, 5), (1, 8)]
    assert records == [(1, 5), (4, 1), (6, 1), (7, 1)]


def test_a_third_of_all_rows_in_one_group(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "same TEXT!").otherwise(F.concat(F.lit("row "), "id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records, copies = collapse_copies(df, "row_id", F.col("text"), F.lit(False))
        assert records.where("copies > 1").collect() == [(0, n // 3)]
        assert copies.where("first_id = 0").count() == copies.count() == n // 3 - 1
        assert copies.select("copy_id").distinct().count() == n // 3 - 1
        assert records.count() == n - n // 3 + 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_equal_ids(spark):
    assert found(spark, []) == ([], [])
    assert found(spark, [(1, "a", "text"), (1, "A", "text")]) == ([(1, 2)], [(1, 1)])


def test_long_text(spark):
    long = "wort 1,5 " * 40_000
    assert found(spark, [(1, long, "text"), (2, long.upper(), "text")])[1] == [(1, 2)]


def test_control_sign_of_fields_in_a_text(spark):
    df = spark.createDataFrame([("a\x01b",), ("ab",)], "t string")
    assert [r[0] for r in df.select(canonical(F.col("t"), F.lit(False))).collect()] == ["ab", "ab"]
