import datetime as dt

from loamworks.operators.references import Reference, orphan_report, orphans

T0, T1, T2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))
CHILD = "id string, ref string, created_at timestamp_ntz, key string"
PARENT = "id string, created_at timestamp_ntz, born string"
LOG = "table_name string, record_id string, deleted_at timestamp_ntz"


def run(spark, child, parent, log):
    c, p, d = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT), spark.createDataFrame(log, LOG)
    return orphans([Reference("kids", c, "ref", "parents", p)], d)


def test_reasons_padding_repeats_and_clashing_columns(spark):
    child = [
        ("1", "A", T1, "x"), ("2", " a\t", T1, "x"), ("3", "b", T1, "x"), ("4", "c", T1, None), ("5", "d", T1, "x"), ("6", "", T1, "x"), ("7", None, T1, "x"),
        ("8", "b", None, "x"), ("9", "r", T1, "x"), ("3", "b", T1, "x"), ("10", "n", T1, "x"), ("11", "D ", None, "x"),
    ]
    parent = [("a", T0, "?"), ("b", T2, "?"), ("r", T0, "?"), ("a", T0, "?"), ("n", None, "?"), (None, T0, "?")]
    log = [("parents", "D", T2), ("parents", "r", T1), ("others", "c", T1), ("parents", None, T1), (None, "c", T1)]
    got = {(r["row_id"], r["reason"]) for r in run(spark, child, parent, log).collect()}
    assert got == {("3", "late"), ("4", "missing"), ("5", "deleted"), ("11", "deleted")}
    assert run(spark, child, parent, log).count() == 4


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, "?")], []).count() == 0
    assert [r["reason"] for r in run(spark, [("1", "a", T1, None)], [], []).collect()] == ["missing"]


def test_hot_key_and_long_key(spark):
    child = [(str(i), "hot" if i % 3 == 0 else "k" * 5000, T1, None) for i in range(300)]
    got = run(spark, child, [("hot", T2, None)], []).groupBy("reason").count().collect()
    assert {(r["reason"], r["count"]) for r in got} == {("late", 100), ("missing", 200)}


def test_report_has_a_row_for_rows_without_time(spark):
    got = orphan_report(run(spark, [("1", "x", None, None), ("2", "x", T1, None)], [], [])).collect()
    assert {(r["month"], r["n_rows"]) for r in got} == {(None, 1), ("2024-02", 1)}
