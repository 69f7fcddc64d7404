import pytest
from pyspark.sql import functions as F

from loamworks.operators.evidence import concentration, justification, merged_members, rubric_level, to_dimensions

EVIDENCE = "k string, source string, score double, confidence double"
WEIGHTS = "source string, dimension string, weight double, reliability double"


def test_every_dimension_comes_out_and_confidence_never_falls(spark):
    w = spark.createDataFrame([("x", "d1", 0.8, 0.9), ("x", "d2", 0.2, 0.9), ("y", "d1", 0.5, 0.5)], WEIGHTS)
    rows = [("a", "x", 50.0, 0.5), ("a", "y", 150.0, 1.0), ("b", "?", 10.0, 0.5), ("b", "x", None, 0.5), ("c", "x", -5.0, None)]
    got = {(r["k"], r["dimension"]): r for r in to_dimensions(spark.createDataFrame(rows, EVIDENCE), w, ["k"], ["d1", "d2", "d3"]).collect()}
    assert len(got) == 9
    assert got["a", "d1"]["score"] == pytest.approx((50 * 0.8 + 100 * 0.5) / 1.3) and got["a", "d1"]["sources"] == "x,y"
    assert got["a", "d1"]["confidence"] == pytest.approx(1 - 0.55 * 0.5) and got["a", "d2"]["confidence"] == pytest.approx(0.45)
    assert got["b", "d1"]["score"] == 50 and got["b", "d1"]["confidence"] == 0 and got["c", "d1"]["score"] == 0 and got["c", "d1"]["confidence"] == 0
    assert to_dimensions(spark.createDataFrame([], EVIDENCE), w, ["k"], ["d1"]).count() == 0


def test_rubric(spark):
    level, found = rubric_level(F.col("t"), {2: ("red", "blue"), 3: ("green", "gold")}, {2: 1, 3: 2})
    rows = spark.createDataFrame([("red",), ("green gold",), ("green redder",), ("Green, GOLD and red",), ("",), (None,)], "t string").select(level.alias("l"), found.alias("n")).collect()
    assert [(r["l"], r["n"]) for r in rows][:5] == [(2, 1), (3, 2), (1, 0), (3, 2), (1, 0)]


def test_members_merge(spark):
    rows = [("a", None, "Director", None, None, "x", None), ("a", "long bio", "Chair", True, 2.0, "y ", None), ("a", "bio", "CFO", False, 5.0, None, None)]
    t = spark.createDataFrame(rows, "k string, bio string, title string, is_independent boolean, tenure_years double, committees string, created_at timestamp")
    r = merged_members(t, ["k"]).first()
    assert (r["bio"], r["title"], r["is_independent"], r["tenure_years"], r["committees"]) == ("long bio", "CFO", True, 5.0, ["x", "y"])


def test_concentration_and_justification(spark):
    t = spark.createDataFrame([("k", "A", "senior"), ("k", "B", "mid")], "k string, title string, level string")
    assert concentration(t, "k").first()["concentration"] == pytest.approx(0.4 * 0.5 + 0.3 / (2**0.5 + 0.1) + 0.2 * (1 - 2 / 15))
    p = spark.createDataFrame([("k", "Red and blue", 0.9), ("k", "red", 0.9), ("m", None, 0.1)], "k string, content string, confidence double")
    got = {r["k"]: (r["matching"], r["gaps"], r["strength"]) for r in justification(p, ["k"], ("red", "blue", "gold")).collect()}
    assert got["k"] == (2, "gold", "strong") and got["m"][0] == 0 and got["m"][2] == "weak"
