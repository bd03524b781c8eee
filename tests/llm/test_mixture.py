from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("fathomline.llm")

from fathomline.llm import mixture as M  # noqa: E402


def sized(spark, n=6000):
    source = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, "small").otherwise("mid")
    return spark.range(n).select("id", source.alias("source"), (F.col("id") * 7919 % 400 + 1).alias("tokens"))


def targets(spark):
    return spark.createDataFrame([("BIG ", 0.5, 2), ("small", 0.3, 3), ("mid", 0.2, 1), ("absent", 0.0, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    rows = sized(spark)
    rates = M.plan(rows, targets(spark), 300_000)
    chosen = M.copies(rows, rates)
    by = {r.source: r for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m"), F.count("*").alias("n")).collect()}
    rate = {r.source: r for r in rates.collect()}
    assert rate["small"].capped and rate["small"].rate == 3.0 and by["small"].m == 3
    assert by["small"].n == rate["small"].docs and not rate["big"].capped and rate["absent"].rate == 0
    assert by["big"].t == pytest.approx(150_000, rel=0.01) and by["mid"].t == pytest.approx(60_000, rel=0.02) and by["mid"].m == 1


def test_copies_are_the_floors_of_one_line(spark):
    rows = sized(spark).where("source = 'big'")
    rates = M.plan(rows, targets(spark), 900_000)
    rate = rates.where("source = 'big'").first().rate
    chosen = M.copies(rows, rates).collect()
    total, n = sum(r.copies for r in chosen), rows.count()
    assert abs(total - n * rate) < 1 and {r.copies for r in chosen} <= {int(rate), int(rate) + 1}
    assert sorted(map(tuple, M.copies(rows.repartition(7), rates).collect())) == sorted(map(tuple, chosen))


def test_all_present_sources_reach_their_share(spark):
    """Without a total: the scarcest source sets it, and the shares are exact up to about one document."""
    rows = sized(spark)
    rates = M.plan(rows, targets(spark))
    assert rates.where("source = 'small'").first().rate == 3 and M.largest_total([(0.5, 100), (0.5, 1000)], 0) == 200
    assert M.largest_total([(0.01, 1), (0.49, 490), (0.5, 1000)], 0.01) == pytest.approx(491 / 0.49) and M.largest_total([], 0.1) == 0
    rates = M.plan(rows, targets(spark), round(rates.where("source = 'small'").select(F.col("tokens") * 3 / F.col("target_share")).first()[0]))
    chosen = M.copies(rows, rates)
    plan = {r.source: r for r in rates.collect()}
    assert not any(r.capped for r in plan.values()) and plan["small"].rate == pytest.approx(3)
    by = {r.source: r for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()}
    total = sum(r.t for r in by.values())
    for name in ("big", "small", "mid"):
        assert abs(by[name].t - plan[name].target_share * total) <= 401 and by[name].m <= plan[name].max_repeats
    order = sorted(rows.where("source = 'mid'").collect(), key=lambda r: r.tokens)
    copies = {r.id: r.copies for r in chosen.where("source = 'mid'").collect()}
    rate, sums = plan["mid"].rate, [0]
    for r in order:
        sums.append(sums[-1] + copies.get(r.id, 0))
    lengths = [r.tokens for r in order]
    for i in range(1, len(order)):  # between lengths the copies are the prefix sums' whole numbers
        if lengths[i] != lengths[i - 1]:
            assert abs(sums[i] - i * rate) < 1


@pytest.mark.skipif(not Path(M.TOKENIZER).exists(), reason="no vocabulary file")
def test_mix(spark):
    docs = spark.createDataFrame(
        [(i, "Ein Text mit einigen Wörtern. " * (i % 5 + 1), ["A ", "b", None, "other"][i % 4], 1, 2) for i in range(200)] + [(900, None, "a", 1, 2), (901, "", "a", 1, 2), (902, "wort" * 5000, "B", 1, 2)],
        "doc_id bigint, text string, source string, tokens int, copies int",
    )
    want = spark.createDataFrame([("a", 0.25, 2), ("b", 0.75, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(docs, "doc_id", F.col("text"), F.col("source"), want)
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].taken == 0 and got["gone"].share == 0 and abs(sum(r.share for r in got.values()) - 1) < 1e-9
    assert got["a"].taken == chosen.where("source = 'a'").agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert not {900, 901} & {r.id for r in chosen.collect()} and {r.source for r in chosen.collect()} == {"a", "b"}
    none, shares = M.mix(docs.where("false"), "doc_id", F.col("text"), F.col("source"), want)
    assert none.count() == 0 and shares.count() == 3
