import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamworks.functions import dates as da
from loamworks.functions.signal_words import COMMITTEE_PATTERNS, FORM_HEADINGS
from loamworks.functions.text import committees, form_like, squished, whole_word_hits
from loamworks.operators import signals as sig
from loamworks.operators.evidence import cited, concentration, rubric_confidence, rubric_scored


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("ml engineer", "", 0.25), ("ai engineer for machine learning", "", 0.4), ("deep learning engineer", "pytorch and cuda", 0.5), ("project manager", "pytorch, sklearn and aws", 0.075), ("project manager for ai", "", 0.25),
        ("clerk", "", 0.0), ("clerk", "deep learning inference", 0.32), ("", "", 0.0),
    ],
)
def test_job_relevance(spark, title, text, want):
    assert one(spark, sig.job_relevance(F.col("a"), F.col("b")), a=title, b=text) == pytest.approx(want)


@pytest.mark.parametrize(("share", "want"), [(0.0, 1), (0.025, 2), (0.035, 4), (2.0, 100)])
def test_shares_become_scores_rounded_half_to_even(spark, share, want):
    assert one(spark, sig.signal_score(F.col("a")), a=share) == want


@pytest.mark.parametrize(("title", "text", "want"), [("about", "", 0.0), ("our platform", "", 0.0), ("home", "snowflake and kafka", 0.14), ("our platform", "snowflake", 0.17), ("x", "openai chatgpt", 0.3)])
def test_tech_adoption(spark, title, text, want):
    assert one(spark, sig.tech_adoption(F.col("a"), F.col("b")), a=title, b=text) == pytest.approx(want)


def test_patents(spark):
    rows = [("k", "Neural network for image recognition", dt.date(2025, 1, 1)), ("k", "Forecasting", dt.date(2020, 1, 1)), ("k", None, None), ("m", "a hinge", dt.date(2024, 6, 30))] + [("n", "nlp robotics", dt.date(2025, 6, 1))] * 30
    t = spark.createDataFrame(rows, "k string, text string, filed date")
    got = {r["k"]: (r["n"], r["recent"], r["categories"], r["score"], r["maturity"]) for r in sig.patent_activity(t, ["k"], F.lit("2025-06-30").cast("date")).collect()}
    assert got == {"k": (3, 1, 3, 47, "AI Experimenter"), "m": (1, 1, 1, 17, "Limited AI Innovation"), "n": (30, 30, 2, 90, "AI Innovator")}
    flags = sig.patent_flags(F.lower("text"), F.col("codes"))
    r = spark.createDataFrame([("a hinge", ["g06v10/2", None])], "text string, codes array<string>").select(*[f.alias(c) for c, f in flags.items()]).first()
    assert r["computer_vision"] and not r["ml_core"]
    assert sig.patent_activity(t.where("false"), ["k"], F.lit("2025-06-30").cast("date")).count() == 0


def test_leadership(spark):
    rows = [("1", "k", "Chief AI Officer", None, 0), ("1", "k", "Chief AI Officer", None, 0), ("2", "k", "VP of Data Science", "Ph.D. in machine learning", 0), ("3", "k", None, None, 0), ("4", "m", "Gardener", "", 0)]
    got = {r["k"]: (r["n"], r["score"]) for r in sig.leadership(spark.createDataFrame(rows, "id string, k string, title string, bio string, w int"), ["k"]).collect()}
    assert got["k"] == (3, pytest.approx((1.0 + 0.7 * 0.8) / (1.0 + 0.7 + 0.5))) and got["m"] == (1, 0.0)


def test_job_titles_are_no_leaders_and_placeholders_say_nothing(spark):
    says = ["Senior Deep Learning Engineer", "Ann Lee — Engineer", "engineer", None, "Board of directors"]
    t = spark.createDataFrame([(x,) for x in says], "c string").select(sig.looks_like_job(F.col("c")).alias("x"))
    assert [r["x"] for r in t.collect()] == [True, False, False, False, False]
    rows = [("innovation_activity", 0.0, "0 AI patents in 5 years", 3), ("innovation_activity", 1.0, "0 ai patents", 0), ("digital_presence", 0.0, "Scan failed", 2), ("technology_hiring", 0.0, "Engineer", 0), ("technology_hiring", 0.0, None, 0), ("leadership_signals", 0.0, "", None), ("other", 0.0, None, 0), (None, None, None, None)]
    t = spark.createDataFrame(rows, "c string, s double, r string, n bigint").select(sig.placeholder(F.col("c"), F.col("s"), F.col("r"), F.col("n")).alias("x"))
    assert [bool(r["x"]) for r in t.collect()] == [True, False, True, False, True, False, False, False]


@pytest.mark.parametrize(("title", "want"), [("Chief of Staff", "senior"), ("Senior Analyst", "mid"), ("Junior Clerk", "entry"), ("Clerk", "mid"), (None, "mid")])
def test_posting_levels(spark, title, want):
    assert one(spark, sig.posting_level(F.col("a")), a=title) == want


def test_broad_scores(spark):
    words = "technology digital data analytics systems platform software cloud automation innovation strategy strategic growth revenue efficiency operations customers market competitive value risk governance compliance oversight controls".split()
    for n, want in [(0, 20), (3, 32), (6, 43), (12, 58), (25, 77.5)]:
        text = " ".join(w for w in words if w != "strategic")[:0] + " ".join(words[:n])
        assert one(spark, sig.broad_score(F.col("a")), a=text) == want


RUBRIC, LEAST = {5: ("red", "blue", "c++"), 4: ("green", "gold"), 2: ("grey",)}, {5: 2, 4: 1, 2: 1}


@pytest.mark.parametrize(
    ("text", "metric", "want"),
    [
        ("Red and blue", None, (5, 80.0, 2, 0.585)), ("red blue c++", None, (5, 100.0, 3, 0.675)), ("green", None, (4, 60.0, 1, 0.45)), ("green gold", None, (4, 79.0, 2, 0.585)), ("grey", None, (2, 29.5, 1, 0.45)),
        ("redder", None, (1, 15.0, 0, 0.3)), (None, None, (1, 15.0, 0, 0.3)), ("red blue", 0.5, (2, None, None, None)), ("green red blue", 0.5, (4, 60.0, 1, 0.495)), ("green", 0.9, (4, 65.0, 1, 0.495)),
    ],
)
def test_rubric_scores(spark, text, metric, want):
    t = spark.createDataFrame([(text, metric)], "t string, m double")
    r = rubric_scored(t, "t", RUBRIC, LEAST, "m", {5: 0.8, 4: 0.5, 2: 0.1}).first()
    if text == "red blue" and metric:
        assert r["level"] == 1
    else:
        assert (r["level"], r["found"]) == (want[0], want[2]) and r["score"] == pytest.approx(want[1]) and r["confidence"] == pytest.approx(want[3])


def test_words_are_no_patterns(spark):
    assert one(spark, F.array_join(whole_word_hits(F.col("a"), ("c++", "a.b", "x")), ","), a="C++ and axb, x1") == "c++"
    assert one(spark, rubric_confidence(F.col("a"), F.col("b"), True), a=1, b=20_000) == pytest.approx(0.605)


def test_cited_passages(spark):
    rows = [("k", "1", "Data and red things"), ("k", "2", "data and red things"), ("k", "2", "data and red things"), ("k", "3", "platform"), ("k", "4", None), ("k", "5", "none"), ("m", "6", "RED")]
    t = spark.createDataFrame(rows, "k string, id string, content string")
    assert sorted(tuple(r) for r in cited(t, ["k"], ("data platform", "red"), "id").collect()) == [("k", "1", 2, 1), ("k", "2", 2, 2), ("k", "3", 1, 3), ("m", "6", 1, 1)]
    assert cited(t, ["k"], ("data platform", "red"), "id", top=1, prefix=0).count() == 2


def test_mentions_raise_the_concentration(spark):
    t = spark.createDataFrame([("k", "A", "senior", 3), ("k", "B", "mid", 0)], "k string, title string, level string, m int")
    plain, named = concentration(t, "k").first()["concentration"], concentration(t, "k", "m").first()["concentration"]
    assert named == pytest.approx(plain + 0.1)


def test_committees_forms_and_names(spark):
    assert one(spark, F.array_join(committees(F.col("a"), COMMITTEE_PATTERNS), "|"), a="the Audit  committee, nominating and governance committee; audit committee; Cyber committee") == "Audit Committee|Nominating And Governance Committee|Cyber Committee"
    says = ["x" * 60, "short", "1 2 3 4 " * 20, "Table of Contents and more words here to fill up the space of a line", None]
    t = spark.createDataFrame([(x,) for x in says], "c string").select(form_like(F.col("c"), FORM_HEADINGS).alias("x"))
    assert [r["x"] for r in t.collect()] == [False, True, True, True, True]
    assert one(spark, squished(F.col("a")), a="A-B & Co. 9") == "abco9"


@pytest.mark.parametrize(("raw", "want"), [("Tesla, Inc.", "Tesla"), ("General Electric Company", "General Electric"), ("Dollar General Corporation Inc", "Dollar General"), ("Inc", "Inc"), ("A B C", "A B")])
def test_search_terms(spark, raw, want):
    assert one(spark, da.search_term(F.col("a")), a=raw) == want


def test_dates(spark):
    times = ["2024-05-01T10:00:00Z", "2024-05-01 10:00:00.123", "2024-05-01", "?", "", None]
    t = spark.createDataFrame([(x,) for x in times], "c string").select(F.date_format(da.parsed_time(F.col("c")), "yyyy-MM-dd").alias("x"))
    assert [r["x"] for r in t.collect()] == ["2024-05-01"] * 3 + ["0001-01-01"] * 3
    folders = ["0000320193-24-000123", "0000320193-99-000123", "x-y-z", "none", None]
    t = spark.createDataFrame([(x,) for x in folders], "c string").select(da.accession_date(F.col("c")).alias("d"), da.filing_address(F.lit("https://filings.example"), F.col("c"), F.lit("f.txt")).alias("u"))
    got = [(r["d"], r["u"]) for r in t.collect()]
    assert got[0] == (dt.date(2024, 1, 1), "https://filings.example/320193/000032019324000123/f.txt") and got[1][0] == dt.date(1999, 1, 1) and got[2][0] is None and got[3] == got[4] == (None, None)
    assert [one(spark, da.tenure(F.col("a"), F.lit(2025)), a=y) for y in (2020, 1950, 2026)] == [5, None, None]
    assert [one(spark, da.ticker_like(F.col("a")), a=x) for x in ("GE", "NVDA", "g", None)] == [True, False, False, False]


def test_narrative_lines(spark):
    from loamworks.operators.documents import narrative_lines

    keep = ["The plan was approved by the board in May.", "", "https and www were told apart here (twice)."]
    drop = ["FORM 10-K annual", "us-gaap:Assets 12", "12", "Page 7", "(1,234)", "1.0 2.0 3.0", "$ 1,200", "exhibit41.htm", "EX-4.1 exhibit.htm", "In millions, except shares", "________", "12 34 56 78 90 a", "((a))((b))((c))((d))((e))", "M" + "#" * 60, "=-+" * 30]
    text = "\r\n".join([keep[0], *drop[:8], keep[1], *drop[8:], keep[2]]) + "\nbegin 644 a.gif\nM12345\nnever told\nend\nAfter the block.\nbegin 644 b.gif\nlost"
    t = spark.createDataFrame([(text,), (None,), ("",)], "c string").select(narrative_lines(F.col("c")).alias("x"))
    assert [r["x"] for r in t.collect()] == ["\n".join(keep) + "\nAfter the block.", None, ""]


def test_sections_and_chunks(spark):
    from loamworks.operators import documents as do

    line = "The plan was good and it went on for the whole year. "
    text = "Intro words. " * 100 + "\n\nITEM 1. Business\n\n" + (line * 30 + "\n\n") * 12 + "\nItem 1A: Risk\n\nShort line\n\n" + line * 60
    spans = do.heading_spans(text, "10K")
    assert [s for s, _, _ in spans] == ["Intro", "Item 1", "Item 1A"] and all(a < b for _, a, b in spans)
    assert do.heading_spans("\nItem 1. a\nItem 1A. b", "10K")[0][0] == "Item 1" and len(do.heading_spans("\nItem 1. a\nItem 1A. b", "10K")) == 1
    assert do.heading_spans("no headings", "10K") == [("Unknown", 0, 11)] == do.heading_spans("no headings", "?")
    assert [s for s, _, _ in do.heading_spans("x\n Compensation Discussion and  Analysis \n" + line * 9, "DEF14A")] == ["CD&A"]
    chunks = do.section_chunks(text)
    assert all(len(c.split()) <= 1000 for c in chunks) and all(len(c.split()) >= 500 for c in chunks[:-1])
    assert all(a.split()[-75:] == b.split()[:75] or len(b.split()) > 925 for a, b in zip(chunks, chunks[1:]))
    assert do.section_chunks("") == [] and do.section_chunks("one two") == ["one two"] and [len(c.split()) for c in do.section_chunks("word " * 2500)] == [1000, 1000, 575]
    assert do.noise("1 2 3") and do.noise("\n".join(["a b"] * 12)) and not do.noise(line * 3)
    assert do.blocks("tiny\n\n" + line * 3 + "\n\ntail") == ["tiny\n" + (line * 3).strip() + "\ntail"] and do.blocks(" ") == []
    rows = [(1, "10K", text, "x"), (2, None, None, "x"), (3, None, "  ", "x"), (4, None, "alone", "x")]
    got = do.filing_chunks(spark.createDataFrame(rows, "doc_id bigint, form string, text string, section string"), 100, 200, 10).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and [r["chunk_index"] for r in got if r["doc_id"] == 1] == list(range(sum(r["doc_id"] == 1 for r in got)))
    assert all(r["start"] is None or text[r["start"] : r["end"]].split() and r["n_words"] <= 200 for r in got if r["doc_id"] == 1)
