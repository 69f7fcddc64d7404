import datetime as dt
import random

from loamworks.operators.asof import as_of


def test_against_brute_force(spark):
    rng = random.Random(1)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 300))
    left = [(i, rng.choice("ab" + "c" * 5), at()) for i in range(300)] + [(300, None, at()), (301, "a", None), (302, "z", at())]
    right = [(rng.choice("abc"), at(), float(k)) for k in range(80)] + [("a", None, 1.0), (None, at(), 1.0)]
    got = as_of(spark.createDataFrame(left, "id int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v double"), "k", "ts", ["v"]).collect()
    assert len(got) == len(left)
    for r in got:
        seen = [(t, v) for k, t, v in right if r["k"] is not None and r["ts"] is not None and k == r["k"] and t is not None and t <= r["ts"]]
        assert r["v"] == (max(seen)[1] if seen else None), r


def test_empty_sides(spark):
    a, b = spark.createDataFrame([], "id int, k string, ts timestamp_ntz"), spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert as_of(a, b, "k", "ts", ["v"]).count() == 0
    one = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "id int, k string, ts timestamp_ntz")
    assert [r["v"] for r in as_of(one, b, "k", "ts", ["v"]).collect()] == [None]
