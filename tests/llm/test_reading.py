import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fathomline.llm")

from fathomline.llm import reading as R  # noqa: E402


def of(text):
    return dict(zip(R.FEATURES, R.features(text)))


def test_counts():
    f = of("Ein Maß hier. Donaudampf 3,5 fährt!? Nr.5 ist\n\nneu und gut")
    assert f["words"] == 10 and f["sentences"] == 4
    assert f["long_words"] == 1 and f["lix"] == pytest.approx(10 / 4 + 100 / 10)
    assert of(None)["words"] == of("")["words"] == of("... 12 !")["lix"] == 0
    assert of("Maße")["word_length"] == 5


def test_trees_fit_and_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 4))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] ** 2 + 0.1 * rng.standard_normal(1500)
    model = R.fit_trees(x[:1000], y[:1000], np.ones(1000))
    assert np.mean((model.predict(x[1000:]) - y[1000:]) ** 2) < 0.15 * y.var()
    a, b = R.rising_fit(rng.random(200), rng.random(200), np.ones(200))
    assert (np.diff(b) > 0).all() and (np.diff(a) > 0).all()


def test_least_grade_bounds_all_texts_of_a_kind():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(R.FEATURES)))
    at = R.FEATURES.index("lix")
    y = 1 + 3 * x[:, at] + 0.3 * x[:, 0] + 0.2 * rng.standard_normal(3000)
    trees = R.fit_trees(x[:1500], y[:1500], np.ones(1500))
    model = R.ReadingModel(trees, np.array([0.0, 5.0]), np.array([1.0, 4.0]), [])
    kind = (x[:, at] >= 0.7) & (x[:, 0] >= 0.2)
    least = model.least_grade(lix=0.7, words=0.2)
    assert (model.grades(x[kind]) >= least).all() and least > model.least_grade(lix=0.1) and (model.grades(x) < least).mean() > 0.3


EASY = "Der Ball ist rot. Das Haus ist neu. Wir sind da. Ein Hund kam."
HARD = "Ungeachtet der durchgeführten Verwaltungsvereinfachung obliegt der zuständigen Dienststelle die abschließende Beurteilung, inwieweit einzelne Bestandteile aufgrund fehlender Nachweisführung nachträglich dokumentiert werden müssen."


def test_levels(spark):
    docs = [(i, (EASY if i % 2 else HARD) + f" Nummer {i}.", f"s{i % 7}", "DE", 1) for i in range(120)] + [(500, None, None, None, 1), (501, "", "s1", "en", 1), (502, "wort " * 100_000, "s1", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, grade int")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4, r) for i in range(0, 80) for r in "ab"] + [(7, 4, "c"), (9999, 1, "a"), (None, 1, "a"), (3, None, "a")], "doc_id bigint, grade int, rater string")
    model = R.fit_reading(df, "doc_id", F.col("text"), F.col("source"), labels)
    assert sum(f[1] for f in model.folds) == 80 and all(f[2] < f[3] for f in model.folds)
    got = {r.id: r for r in R.reading_levels(df, "doc_id", F.col("text"), F.col("source"), F.col("lang"), model).collect()}
    assert len(got) == 123 and got[101].level == 1 and got[100].level == 4 and got[101].lang == "de"
    assert got[500].grade is None and got[501].level is None and got[502].words == 100_000
    assert R.level_profile(R.reading_levels(df, "doc_id", F.col("text"), F.col("source"), F.col("lang"), model)).agg(F.sum("docs")).first()[0] == 123
    assert R.fit_reading(df.where("false"), "doc_id", F.col("text"), F.col("source"), labels) is None
    none = R.reading_levels(df, "doc_id", F.col("text"), F.col("source"), F.col("lang"), None).where("id = 100").first()
    assert none.grade is None and none.level is None and none.lix == got[100].lix
