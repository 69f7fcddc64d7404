import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamworks.operators.packed import PackedField, segments, unpack


@pytest.mark.parametrize(
    ("text", "names", "values"),
    [
        ('["A, b", "C \\"d\\" e"]', False, ["A, b", 'C "d" e']),
        ("['A', 'B, C']", False, ["A", "B, C"]),
        ('"a ""yes, and"" b",plain', False, ['a "yes, and" b', "plain"]),
        ("x, y | z", False, ["x, y", "z"]),
        ("Audit (Chair, since 2021), Risk", False, ["Audit (Chair, since 2021)", "Risk"]),
        ("1. one\n2. two, three", False, ["one", "two, three"]),
        ("- a/b\r\n- c", False, ["a/b", "c"]),
        ("a/b / c", False, ["a/b", "c"]),
        ("a; ; b;", False, ["a", "b"]),
        ("a, N/A, b", False, ["a", "b"]),
        ("one, two;", False, ["one, two"]),
        ("Ann Lee, Ph.D., Bo Ray and Cy Day, Jr.", True, ["Ann Lee, Ph.D.", "Bo Ray", "Cy Day, Jr."]),
        ("Ann Lee, Bo Ray, and Cy Day", True, ["Ann Lee", "Bo Ray", "Cy Day"]),
        ("Research and Audit, Risk", False, ["Research and Audit", "Risk"]),
        ("don't stop, it's ok", False, ["don't stop", "it's ok"]),
        ("(unclosed, a", False, ["(unclosed", "a"]),
        ("", False, []),
        (None, False, []),
        ("[]", False, []),
        ("none", False, []),
        (" , ;", False, []),
    ],
)
def test_notations(text, names, values):
    assert segments(text, names)[0] == values


WORD = st.text("abcdefgh XY&", min_size=1, max_size=12).map(str.strip).filter(lambda v: v and v.lower() not in {"na", "none"})


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD.map(lambda v: v.replace(" and ", " ")), min_size=2, max_size=6))
def test_round_trips(values):
    assert segments(json.dumps(values), False)[0] == values
    assert segments(" | ".join(values), False)[0] == values
    assert segments("; ".join(values), False)[0] == values
    line = io.StringIO()
    csv.writer(line, quoting=csv.QUOTE_ALL, lineterminator="").writerow(values)
    assert segments(line.getvalue(), False)[0] == values


def test_known_whole_values_are_kept_together(spark):
    rows = [(str(i), '["Health, Safety", "Risk"]', "x") for i in range(3)] + [("9", "Audit, Health, Safety, Risk", "x"), ("10", "Health, Safety", "x")]
    t = {"t": spark.createDataFrame(rows, "id string, f string, item string")}
    got = unpack(t, [PackedField("t", "f")]).collect()
    assert [r["item"] for r in sorted((r for r in got if r["row_id"] == "9"), key=lambda r: r["pos"])] == ["Audit", "Health, Safety", "Risk"]
    assert [r["n_items"] for r in got if r["row_id"] == "10"] == [1]


@pytest.mark.parametrize("most", [1, 50_000])
def test_known_whole_values_beyond_the_broadcast_are_kept_together_too(spark, most):
    rows = [(str(i), '["Health, Safety", "Risk"]') for i in range(3)] + [(f"b{i}", '["Pay, People", "Risk"]') for i in range(2)]
    rows += [("9", "Audit, pay, people , Health, Safety"), (None, "Pay, People, Risk"), ("x", None)]
    got = unpack({"t": spark.createDataFrame(rows, "id string, f string")}, [PackedField("t", "f")], max_entries=most).collect()
    items = {k: [r["item"] for r in sorted((r for r in got if r["row_id"] == k), key=lambda r: r["pos"])] for k in ("9", None)}
    assert items == {"9": ["Audit", "pay, people", "Health, Safety"], None: ["Pay, People", "Risk"]}


def test_nulls_repeats_empty_and_long(spark):
    long = ", ".join(f"v{i}" for i in range(20_000))
    rows = [("1", "a;a", None), ("1", "a;a", None), ("2", None, None), ("3", "", None), ("4", long, None), (None, "a;b", None)]
    t = {"t": spark.createDataFrame(rows, "id string, f string, pos int")}
    got = unpack(t, [PackedField("t", "f")]).collect()
    assert [(r["pos"], r["item"]) for r in got if r["row_id"] == "1"] == [(1, "a"), (2, "a")]
    assert sum(r["row_id"] == "4" for r in got) == 20_000
    assert sum(r["row_id"] is None for r in got) == 2
    assert unpack({"t": spark.createDataFrame([], "id string, f string")}, [PackedField("t", "f")]).count() == 0
