import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamworks.functions.lexicons import DIMENSIONS
from loamworks.functions.numeric import level, noisy_or
from loamworks.functions.text import company_name, domain, shortened, tidy, word_count
from loamworks.operators import changes
from loamworks.operators.documents import chunked, clean_lines, packed_sentences, section_bounds, within_budget
from loamworks.operators.latest import latest_batch, latest_per_key, repeats, trend
from loamworks.operators.ranking import position_in_group, reciprocal_rank_fusion, running_budget, top_mean
from loamworks.operators.retrieval import bm25_top, cosine_top
from loamworks.operators.scoring import chain, culture_scores, governance
from loamworks.sources.files import any_texts, cached_reviews, largest_files, newest_files, result_documents, texts, write_json

def scored(spark, rows, places=4):
    cols = [*DIMENSIONS, "talent_concentration", "percentile", "sector", "evidence_count"]
    schema = ", ".join(f"{c} double" for c in cols[:-2]) + ", sector string, evidence_count bigint"
    return chain(spark.createDataFrame(rows, schema), places)


# Stored results: dimension scores in the order of DIMENSIONS, talent concentration, position, sector, evidence; vr, hr, synergy, final.
GOLDEN = [
    ([64.98871795, 74.28571429, 76.46476193, 64.10125, 71.65355553, 67.61965812, 68.08], 0.2521, 0.2204796, "Unknown", 479, (68.37333767, 77.480625, 52.97604308, 69.7313936)),
    ([47.20065934, 41.63795918, 67.35714286, 67.3375, 60.484, 84.61538462, 60.82210526], 0.2673, 0.4346212, "financial_services", 1838, (57.88514543, 85.2152, 56.97257382, 67.3957952)),
    ([53.51666667, 56.28571429, 75.72142857, 81.86625, 68.08311113, 84.69230769, 61.22526316], 0.2641, 0.612748, "retail", 288, (65.72895657, 76.43335, 45.34061582, 67.0503408)),
    ([27.40777778, 50.0, 55.90523809, 78.67, 50.0, 73.11111111, 50.0], 0.3638, 0.0362852, "technology", 64, (50.37705596, 75.408375, 48.05553483, 58.9095256)),
]


def test_stored_results(spark):
    average = {"financial_services": 55.0, "retail": 48.0, "technology": 65.0}
    rows = [(*x, tc, ((pf - 0.6 * (round(want[0], 4) - average.get(s, 50.0)) / 50) / 0.4) / 2 + 0.5, s, n) for x, tc, pf, s, n, want in GOLDEN]
    got = {r["evidence_count"]: r for r in scored(spark, rows).collect()}
    for *_, n, want in GOLDEN:
        assert [got[n][c] for c in ("vr", "hr", "synergy", "final")] == pytest.approx(want, abs=2e-3)


def test_uniform_dimensions_have_no_penalty(spark):
    r = scored(spark, [(60.0,) * 7 + (0.2, 0.5, "technology", 10)]).first()
    assert r["vr"] == pytest.approx(60.0) and r["hr"] == pytest.approx(75 * (1 + 0.15 * 0.6 * (60 - 65) / 50), abs=1e-3)
    assert r["ci_lower"] < r["final"] < r["ci_upper"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.floats(-500, 500), min_size=7, max_size=7), min_size=40, max_size=60), st.floats(-5, 5))
def test_scores_stay_in_bounds(spark, many, tc):
    rows = [(*x, tc, 0.5, s, n) for x, s, n in zip(many, ["technology", "retail", None, "?"] * 20, [0, 1, 500] * 30)]
    for r in scored(spark, rows).collect():
        assert 0 <= r["vr"] <= 100 and 0 <= r["final"] <= 100 and -1 <= r["position"] <= 1 and r["ci_lower"] <= r["final"] <= r["ci_upper"]


def test_talent_concentration_never_raises_the_score(spark):
    rows = [(50.0, 60.0, 70.0, 40.0, 55.0, 65.0, 30.0, t / 10, 0.5, "retail", 5) for t in range(11)]
    got = [r["vr"] for r in scored(spark, rows).orderBy("talent_concentration").collect()]
    assert all(a >= b for a, b in zip(got, got[1:]))


def test_text_functions(spark):
    r = spark.sql("select 'a \\t b\\r\\n\\r\\n\\r\\nc ' as t, 'https://www.X.example/a/b' as u, 'Foo-Bar, Inc.' as n").select(tidy(F.col("t")).alias("t"), domain(F.col("u")).alias("u"), company_name(F.col("n")).alias("n"), word_count(F.lit("  ")).alias("w"), shortened(F.lit("abcd"), 3).alias("s")).first()
    assert (r["t"], r["u"], r["n"], r["w"], r["s"]) == ("a b\n\nc", "x.example", "foo bar", 0, "abc…")


def test_numeric_functions(spark):
    assert [r[0] for r in spark.createDataFrame([(0.0,), (19.99,), (20.0,), (100.0,)], "x double").select(level(F.col("x"))).collect()] == [1, 1, 2, 5]
    assert spark.createDataFrame([(0.5,), (0.5,)], "x double").agg(noisy_or(F.col("x"))).first()[0] == 0.75


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 1)], "k int, v string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(changes.upsert(base, new, ["k"])) == rows(base.where("k = 1").union(new))
    assert rows(changes.patch(base, new, "k", ["v", "n"])) == [(1, "a", None), (2, "B", 5)]
    assert rows(changes.delete_keys(base, new, ["k"])) == [(1, "a", None)]
    assert rows(changes.insert_absent(base, new.union(new), ["k"])) == [(1, "a", None), (2, "b", 5), (3, "c", 1)]
    assert rows(changes.soft_delete(base, F.col("n") > 1)) == [(1, "a", None, False), (2, "b", 5, True)]
    assert rows(changes.with_defaults(base, {"n": 0})) == [(1, "a", 0), (2, "b", 5)]


def test_replace_partitions_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    changes.replace_partitions(spark.createDataFrame([(3, "a")], "v int, p string"), path, ["p"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}


def test_latest_and_trend(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    t = spark.createDataFrame([("a", day(0), 50.0), ("a", day(300), 62.0), ("b", day(1), 10.0), ("b", None, None)], "k string, at date, s double")
    assert {(r["k"], r["s"]) for r in latest_per_key(t, ["k"], [F.desc_nulls_last("at")]).collect()} == {("a", 62.0), ("b", 10.0)}
    got = {r["k"]: r for r in trend(t, "k", "at", "s", F.lit("2024-11-01").cast("date")).collect()}
    assert got["a"]["delta"] == 12.0 and got["a"]["direction"] == "improving" and got["b"]["direction"] == "stable" and got["b"]["delta_90d"] == 0.0


def test_latest_batch_keeps_what_is_near_the_newest(spark):
    rows = [("a", dt.datetime(2024, 1, 2, 10, 0)), ("a", dt.datetime(2024, 1, 2, 10, 45)), ("a", dt.datetime(2024, 1, 2, 9, 0)), ("a", dt.datetime(2024, 1, 1, 10, 40))]
    t = spark.createDataFrame(rows, "k string, ts timestamp")
    assert latest_batch(t, ["k"], F.to_date("ts"), "ts", 45).count() == 2


def test_position_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("abc"[0 if i % 10 < 8 else i % 3], float(x) if x else None, i) for i, x in enumerate(rng.integers(0, 40, 600))]
    got = {r["i"]: r["pct"] for r in position_in_group(spark.createDataFrame(rows, "g string, s double, i int"), "g", "s", "i", 7).collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == pytest.approx([(k + 1) / len(own) for k in range(len(own))])


def test_repeats_leave_the_first(spark):
    t = spark.createDataFrame([("a", None, "1"), ("a", 5, "3"), ("a", 5, "2"), ("b", None, "4")], "k string, at int, id string")
    assert sorted(r["id"] for r in repeats(t, ["k"], ["at", "id"]).collect()) == ["1", "3"]
    assert repeats(t.where("false"), ["k"], ["at", "id"]).count() == 0


def test_ranking(spark):
    t = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 5.0, 3), ("b", None, 4)], "g string, s double, i int")
    assert [r["pct"] for r in position_in_group(t.where("g = 'a'"), "g", "s", "i").orderBy("i").collect()] == pytest.approx([1 / 3, 2 / 3, 1])
    assert [(r["g"], r["top_mean"]) for r in top_mean(t, ["g"], "s", 2).collect()] == [("a", 3.0)]
    assert [r["within"] for r in running_budget(t.where("g = 'a'"), F.col("g"), ["i"], "s", 2.0).orderBy("i").collect()] == [True, True, False]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "d string, rank int")
    b = spark.createDataFrame([("y", 1)], "d string, rank int")
    got = {r["d"]: r["score"] for r in reciprocal_rank_fusion([(a, 0.6), (b, 0.4)], ["d"]).collect()}
    assert got["y"] == pytest.approx(0.6 / 62 + 0.4 / 61) and got["x"] == pytest.approx(0.6 / 61)


def test_cosine_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = cosine_top(t, t.where("vec_id % 10 = 0"), 3, block=2)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 60, 10):
        s = unit @ unit[q]
        s[q] = -2
        assert [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == list(np.argsort(-s)[:3])
    assert got.where("id >= 60").count() == 0


def test_bm25_prefers_the_document_with_the_rare_word(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common other words"), (4, None), (5, "")], "doc_id bigint, text string")
    got = bm25_top(docs, spark.createDataFrame([(1, "Rare, common!"), (2, None)], "query_id bigint, text string"), 2).orderBy("rank").collect()
    assert got[0]["doc_id"] == 1 and len(got) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["One two three.", "A b.", "Four five six seven eight nine ten!", "x"]), max_size=20), st.integers(2, 9), st.integers(0, 3))
def test_chunks_hold_every_word_in_order(parts, most, overlap):
    overlap = min(overlap, most - 1)
    text = " ".join(parts)
    got = packed_sentences(text, most, overlap)
    assert all(len(c.split()) <= most for c in got)
    assert set(text.split()) == {w for c in got for w in c.split()}
    plain = packed_sentences(text, most, 0)
    assert " ".join(plain).split() == text.split()


def test_document_pipeline(spark):
    t = spark.createDataFrame([(1, "Analyst: " + "word " * 60 + "\nOperator: end."), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in chunked(t, 50, 5).collect()} == {1}
    got = {(r["doc_id"], r["section"]) for r in section_bounds(t, r"^\w+:", 20).collect()}
    assert got == {(1, "Analyst:"), (1, "Operator:"), (3, "Unknown")}
    assert spark.createDataFrame([("prose here\n12,3 | 45\n\nmore",)], "t string").select(clean_lines(F.col("t"))).first()[0] == "prose here\n\nmore"
    b = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "abc"), ("d", 3, "a")], "d string, i int, t string")
    assert [r["i"] for r in within_budget(b, "d", ["i"], "t", 6).orderBy("i").collect()] == [1, 2]


def test_culture_and_governance(spark):
    none = ("2", "c", *[None] * 8)
    reviews = spark.createDataFrame([("1", "c", None, "innovative and agile", "slow", None, None, dt.date(2025, 1, 1), True, 4.0), none, none], "id string, company_id string, title string, pros string, cons string, advice_to_management string, job_title string, review_date date, is_current_employee boolean, rating double")
    r = culture_scores(reviews, ["company_id"], F.lit("2025-06-30").cast("date")).first()
    assert r["review_count"] == 2 and r["innovation"] == pytest.approx(80.0) and r["change_readiness"] == pytest.approx(50.0)
    members = spark.createDataFrame([("1", "s", "Chief Data Officer", "Technology | Risk", "machine learning, cyber", True), ("2", "s", None, None, None, None), ("2", "s", None, None, None, None)], "id string, s string, title string, committees string, bio string, is_independent boolean")
    g = governance(members, ["s"]).first()
    assert g["governance"] == 80 and g["confidence"] == pytest.approx(0.6)
    told = spark.createDataFrame([("s", "Our machine learning plan"), ("s", None), ("t", "x")], "s string, text string")
    assert governance(members, ["s"], strategy=told).first()["governance"] == 90 and governance(members, ["s"], strategy=told.where("false")).first()["governance"] == 80
    titled = reviews.where("id = '1'").withColumn("job_title", F.lit("ML Engineer"))
    assert culture_scores(titled, ["company_id"], F.lit("2025-06-30").cast("date")).first()["ai_awareness"] > 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    (tmp_path / "a" / "y.txt").write_text("a longer text")
    assert sorted(r["content"] for r in texts(spark, str(tmp_path / "a")).collect()) == ["a longer text", "one\ntwo"]
    assert largest_files(spark, str(tmp_path)).first()["path"].endswith("y.txt")
    write_json(spark.createDataFrame([("k", 1)], "t string, v int"), str(tmp_path / "out"), "t")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_files_by_their_bytes_and_age(spark, tmp_path):
    import gzip
    import os

    for k, (folder, name, body) in enumerate([("a", "full-submission.txt", b"main"), ("a", "big.txt", b"x" * 99), ("b", "one.dat", gzip.compress("zipped é".encode())), ("b", "two.txt", b""), ("c", "old.txt", b"bad \xff byte")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(body)
        os.utime(tmp_path / folder / name, (1e9 - 1e6 * (folder == "c") + k, 1e9 - 1e6 * (folder == "c") + k))
    assert sorted(r["content"] for r in any_texts(spark, str(tmp_path), "*[!g].*").collect()) == ["bad  byte", "main", "zipped é"]
    assert [os.path.basename(r["path"]) for r in newest_files(spark, str(tmp_path), 2).collect()] == ["one.dat", "full-submission.txt"]
    (tmp_path / "r").mkdir()
    for t, x in (("A", "1.5"), ("B", "7"), ("C", "null")):
        (tmp_path / "r" / f"{t}_result.json").write_text(f'{{"ticker": "{t}",\n "final_score": {x}}}')
    (tmp_path / "r" / "other.json").write_text('{"ticker": "D", "final_score": 9}')
    assert [r["ticker"] for r in result_documents(spark, str(tmp_path / "r"), "ticker string, final_score double", "final_score").collect()] == ["B", "A", "C"]
    (tmp_path / "r" / "reviews.json").write_text('[{"review_id": "1", "rating": 4, "review_date": "2024-05-01T00:00:00"},\n {"review_id": "2", "review_date": "?"}]')
    assert [(r["review_id"], r["rating"], r["review_date"] and r["review_date"].year) for r in cached_reviews(spark, str(tmp_path / "r" / "reviews.json")).collect()] == [("1", 4.0, 2024), ("2", None, None)]
