import numpy as np
import pytest

from loamworks.llm import pii

FIELDS = ("pros", "cons")
SCHEMA = "id string, pros string, cons string, row_id string, text string"

# Texts made for the tests, and what is private in them.
CASES = [
    ("Contact: ann.lee+x@corp.example today", {"email"}), ("Ask jo_99 (at) corp.example before", {"email"}), ("write to max at corp dot co dot example", {"email"}), ("write me at pat+jobs at corp dot co dot example or so", {"email"}), ("write me at pat.lee at corp dot example", {"email"}), ("jo.lee [@] corp [.] example has it", {"email"}), ("Ask ed {at} corp.example", {"email"}), ("Email overload @ the office", set()), ("Tag @everyone in chat", set()),
    ("Call (212) 555-0161 now", {"phone"}), ("Tel: +44 7700 900031", {"phone"}), ("fax 020 7946 0041 please", {"phone"}), ("rang me on 5555550194", {"phone"}), ("text +33 1 99 00 31 96", {"phone"}), ("call four one five, five five five, zero one six two", {"phone"}), ("ring 4 1 five 5 five 5 zero 1 six 2 now", {"phone"}), ("social security number: four five six seven eight nine one two three", {"id_number"}), ("Ticket INC-204-55-1234 is open", set()), ("cost center 4471-195", set()), ("Orders of 1,200,000 units", set()),
    ("My SSN 971-41-9659 leaked", {"id_number"}), ("passport no. X51844867 in the wiki", {"id_number"}), ("NI number QQ 16 91 43 A", {"id_number"}), ("driver's license D5406663", {"id_number"}), ("job code 739-12-15", set()), ("asset tag Tok259", set()),
    ("letters at 1520 Mohea St. today", {"address"}), ("mailed to P.O. Box 4528, Peabra", {"address"}), ("My home (Cainostraße 132, 15645 Raizi)", {"address"}), ("offsite was at 2049 sene road", {"address"}), ("parking behind Lot 391 behind the plant", set()), ("24 hour drive to quality", set()), ("Wall Street mentality", set()),
    ("I reported to Maria Quelby, who left", {"name"}), ("Had lunch with Robert K. Zunfeld on day one", {"name"}), ("My manager Quelby, Maria never came", {"name"}), ("Big thanks to Dr. Zunfeld for it", {"name"}), ("ask why stella quelby was moved", {"name"}), ("nobody listens except the Glik team", set()), ("The Will to Win crew", set()), ("May was good, Summer was not.", set()), ("Project Grace Harbor was cancelled", set()), ("My lead at Gaglawu shields us", set()), ("", set()), ("   ", set()),
]


def reviews(spark, rows):
    return spark.createDataFrame([(i, p, c, "r", "t") for i, p, c in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return reviews(spark, [(f"{k}-{n}", text, None if k % 3 else "All fine here.") for n in range(12) for k, (text, _) in enumerate(CASES)])


@pytest.fixture(scope="module")
def weights(corpus):
    return pii.fit(corpus, FIELDS)


def test_types_found(corpus, weights):
    got = {}
    for r in pii.found_types(corpus, weights, FIELDS).collect():
        got.setdefault((r["row_id"], r["field_name"]), set()).add(r["pii_type"])
    assert all(f == "pros" for _, f in got)
    wrong = [(text, want, got.get((f"{k}-0", "pros"), set())) for k, (text, want) in enumerate(CASES) if got.get((f"{k}-0", "pros"), set()) != want]
    assert not wrong


def test_redaction_keeps_the_rest(weights):
    assert pii.redacted("Call (212) 555-0161 or ask Maria Quelby, thanks.", weights) == "Call [PHONE] or ask [NAME], thanks."
    assert pii.redacted("Nothing private.", weights) == "Nothing private." and pii.redacted(None, weights) is None and pii.redacted("", weights) == ""
    twice = pii.redacted(pii.redacted("SSN 971-41-9659 and ann@corp.example", weights), weights)
    assert twice == "[ID_NUMBER] and [EMAIL]"


def test_nulls_repeats_empty_and_long(spark, weights):
    long = "good " * 200_000 + "Contact: ann.lee@corp.example"
    t = reviews(spark, [("a", long, None), ("a", long, None), ("b", None, None), ("c", "", " "), (None, "ssn: 985188172 was read", None)])
    assert {tuple(r) for r in pii.found_types(t, weights, FIELDS).collect()} == {("a", "pros", "email"), (None, "pros", "id_number")}
    out = {r["row_id"]: (r["pros"], r["cons"]) for r in pii.redact(t, weights, FIELDS).collect()}
    assert len(out) == 4 and out["a"][0].endswith("[EMAIL]") and out["b"] == (None, None) and out["c"] == ("", " ")
    empty = reviews(spark, [])
    assert pii.found_types(empty, pii.fit(empty, FIELDS), FIELDS).count() == 0


def test_context_words_are_learned(spark):
    rows = [("name", [1], "promote", "already", "a")] * 40 + [("name", [0], "promote", "x", "b")] * 4 + [("name", [-1], "project", "y", "c")] * 40 + [("name", [1], f"w{i}", "", "d") for i in range(9)]
    spans = spark.createDataFrame([(k, v, x, y, 0) for k, v, x, y, _ in rows], "kind string, votes array<int>, left string, right string, h bigint")
    counts = {"name": {(1,): 49, (0,): 4, (-1,): 40}}
    got = pii.context_words(spans, counts, {("name", (1,)): 0.99, ("name", (0,)): 0.5, ("name", (-1,)): 0.01})
    assert {k: set(v) for k, v in got.items()} == {("name", "left"): {"promote", "project"}, ("name", "right"): {"already", "y"}}
    judge = pii.Judge(got, np.zeros(pii.BUCKETS))
    assert [judge.votes("name", [0], a, b) for a, b in [("promote", "already"), ("project", "y"), ("new", "words")]] == [(0, 1), (0, -1), (0, 0)]


def test_reliabilities_learn_which_labeler_to_trust():
    rng = np.random.default_rng(5)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.4
        good = 1 if rng.random() < (0.95 if true else 0.05) else -1
        fair = 1 if rng.random() < (0.8 if true else 0.2) else -1
        noise = 1 if rng.random() < 0.5 else -1
        counts[good, fair, noise] = counts.get((good, fair, noise), 0) + 1
    p = pii.reliabilities({"name": counts})
    assert p["name", (1, 1, -1)] > 0.9 > 0.1 > p["name", (-1, -1, 1)]
    assert abs(p["name", (1, -1, 1)] - p["name", (1, -1, -1)]) < 0.25
    assert pii.reliabilities({}) == {} and not pii.fit_classifier([], {}).any()
