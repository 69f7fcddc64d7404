import itertools
import random

import pytest

from loamworks.llm import mixing as mi
from loamworks.llm import names as na
from loamworks.llm.queries import tokenizer

SEATS = "id string, name string, node string, entity string, bio string"


def links(spark, rows):
    got = na.linked_pairs(spark.createDataFrame([(i, n, "x", "y", "z") for i, n in rows], SEATS))
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Dr. Keiko van Wabrell, Ph.D.", ("person", "wabrell", "keiko", "", "")),
        ("Wabrell III, Keiko N.", ("person", "wabrell", "keiko", "n", "iii")),
        ("KR Wabrell", ("person", "wabrell", "k", "r", "")),
        ("Zoë O'Wabrell", ("person", "owabrell", "zoe", "", "")),
        ("Wabr3ll, Z.", ("person", "wabrell", "z", "", "")),
        ("Wabrell Cap. Ptnrs, L.P. (Observer)", ("org", "wabrellcapitalpartners", "", "lp", "")),
        ("WabrellHarbor Ventures Fund Limited Partnership", ("org", "wabrellharborventures", "", "lp", "")),
        ("", None), (None, None), ("123 !", None),
    ],
)
def test_parsed(raw, want):
    assert na.parsed(raw) == want


def test_links(spark):
    groups = [
        ["Stephen Doklicea", "Doklicea, S.", "Ms. Steve Doklicea", "STEPHEN DOKLICEA", "Setphen Doklicea", "Stephen Dokliceea, CFA"],
        ["Ruth Doklicea", "ruth doklicea", "Doklicea, Ruth"],
        ["Charles L. Cekeasem", "Chas. L. Cekeasem"],
        ["Charles L. Cekeasem, Jr.", "Cekeasem Jr., Charles L."],
        ["Tricia Fetreawi", "Patricia Fetreawi", "Patty Fetreawi"],
        ["Mabodulby Pension Fund Inc.", "Mabodulby Pens. Fd, Incorporated", "Mabodusby Pension Fund Inc."],
        ["Mabodulby Family Trust Inc."],
        ["Victor Zotraidu", "V. Zotraidu?"][:1],
        ["Victoria Zotraidu"],
        ["V. Zotraidu"],
        ["Naomi D. Drekleas"], ["Naomi R. Drekleas"], ["Naomi Drekleas"],
    ]
    seats = [(f"{g:02}-{k}", n) for g, names in enumerate(groups) for k, n in enumerate(names)]
    want = {(f"{g:02}-{a}", f"{g:02}-{b}") for g, names in enumerate(groups) for a, b in itertools.combinations(range(len(names)), 2)}
    assert links(spark, seats) == want


def test_identical_strings_are_no_pair_but_link(spark):
    rows = [("b", "Ann Quelby"), ("a", "Ann Quelby"), ("a", "Ann Quelby"), ("c", "Quelby, Ann"), ("d", None), ("e", ""), (None, "Ann Quelby"), ("f", "Ann " + "q" * 3000)]
    assert links(spark, rows) == {("a", "c"), ("b", "c")}
    assert links(spark, []) == set()


def test_a_hot_family_of_many_persons(spark):
    given = ["Ann", "Bob", "Carla", "Dora", "Edward", "Felix", "Gloria", "Hugo", "Irene", "James"]
    rows = [(f"{i:04}", f"{given[i % 10]} {chr(65 + i // 10 % 26)}. Smithson") for i in range(260)] + [("x", "Smithson, Hugo C.")]
    assert len(links(spark, rows)) == 1


def test_a_misspelling_links_however_often_it_stands(spark):
    def linked(times):
        rows = [(f"{n}-{k}", n) for n in ("Stephen Doklicea", "Stephen Dokliceea", "Ruth Fetreawi", "Ruth Fetreawy", "Anna Petersen", "Anna Peterson", "Ruth Petersen") for k in range(times)]
        return {tuple(sorted(x.rsplit("-", 1)[0] for x in pair)) for pair in links(spark, rows)}

    assert linked(1) == linked(4) == {("Stephen Doklicea", "Stephen Dokliceea"), ("Ruth Fetreawi", "Ruth Fetreawy"), ("Anna Petersen", "Anna Peterson")}


def test_crowded_forms_are_split_without_loss(spark):
    rng = random.Random(4)
    given = ["John", "Jon", "Johnny", "Jhon", "J.", "Jonathan", "Jonahtan", "Jane", "Jame", "James", "Jim", "Jeremias", "Jeremais", "J", "Jerry", "Gerald", ""]
    family = ["Smith", "Smyth", "Smitth", "Smithsonian", "Smithsonina", "Smithsoniann", "Smithsonain"]
    rows = sorted({f"{rng.choice(given)} {rng.choice(['', 'A.', 'B.'])} {rng.choice(family)}{rng.choice(['', ', Jr.'])}" for _ in range(300)} | {"Smithson Capital Partners LLC", "Smithsn Capital Partners", "Smithson Capitl Partners LLC"})
    seats = spark.createDataFrame([(f"{i:03}", n, "x", "y", "z") for i, n in enumerate(rows)], SEATS)
    one, other = ({(r["member_id"], r["entity"]) for r in na.entities(seats, crowd=c).collect()} for c in (1, 10_000))
    assert one == other and len({e for _, e in one}) < len(rows)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_a_long_chain_is_one_component(spark, n):
    order = random.Random(1).sample(range(1000, 1000 + n), n)
    edges = [(str(order[i]), str(order[i + 1])) for i in range(n - 1)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["entity"] for r in na.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**({str(i): "1000" for i in order} if n > 1 else {}), "x": "x", "y": "x"}


def test_distance_is_restricted_damerau():
    assert [na.distance(a, b, 2) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abc", "abcd"), ("abcdef", "ghijkl"), ("", "ab")]] == [0, 1, 1, 1, 3, 2]


DOCS = "doc_id bigint, text string, source string, n_tokens bigint, repeats int"
TARGETS = "source string, target_share decimal(6,4), max_repeats int, tokens bigint"


def mixed(spark, docs, targets, **how):
    d = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in docs], DOCS)
    t = spark.sql("select 1").sparkSession.createDataFrame([(s, float(x), r) for s, x, r in targets], "source string, target_share double, max_repeats int")
    mix = mi.mixture(d, t, tokenizer(spark), **how)
    return [r.asDict() for r in mix.collect()], [r.asDict() for r in mi.mixture_shares(mix, t).collect()]


def corpus(n=300):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    return [(i, " ".join(rng.choices(words, k=rng.randint(5, 60))) + f" {i}", "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(n)]


def test_shares_are_met_and_repeats_are_capped(spark):
    mix, shares = mixed(spark, corpus(), [("a", 0.2, 2), ("b", 0.4, 3), ("c", 0.4, 2), ("none", 0.1, 5)])
    by = {r["source"]: r for r in shares}
    assert by["none"]["tokens"] == 0 and sum(r["actual_share"] for r in shares) == pytest.approx(1)
    for s, x in (("a", 0.2), ("b", 0.4), ("c", 0.4)):
        assert by[s]["actual_share"] == pytest.approx(x, abs=0.03)
    assert by["c"]["most_repeats"] == 2 and all(1 <= r["repeats"] <= 3 for r in mix) and len({r["doc_id"] for r in mix}) == len(mix)


def test_a_size_that_cannot_be_met_is_filled_as_far_as_it_goes(spark):
    mix, shares = mixed(spark, corpus(), [("a", 0.5, 1), ("c", 0.5, 2)], total_tokens=1e9)
    assert {r["repeats"] for r in mix if r["source"] == "c"} == {2} and {r["repeats"] for r in mix if r["source"] == "a"} == {1}
    assert sum(r["source"] == "a" for r in mix) == 210


def test_seeds_and_unlisted_groups(spark):
    targets = [("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2)]
    docs = corpus() + [(1000 + i, t, "bca"["abc".index(s)]) for i, t, s in corpus(60)]
    one, same, other = (mixed(spark, docs, targets, seed=s)[0] for s in (1, 1, 2))
    key = lambda rows: sorted((r["doc_id"], r["repeats"]) for r in rows)
    assert key(one) == key(same) != key(other)
    few = {r["source"]: r["actual_share"] for r in mixed(spark, docs, targets, max_groups=1)[1]}
    assert all(few[s] == pytest.approx(x, abs=0.05) for s, x, _ in targets)


def test_nulls_empty_and_repeated_rows(spark):
    docs = [(1, "one two three", "a"), (1, "one two three", "a"), (2, "one two three", "a"), (3, None, "a"), (4, "", "a"), (5, "x " * 100_000, None), (6, "four five", "untargeted")]
    mix, shares = mixed(spark, docs, [("a", 1.0, 1)])
    assert [(r["doc_id"], r["repeats"]) for r in mix] == [(1, 1)]
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == [] and mixed(spark, docs, [])[0] == []


def test_flow_prefers_first_uses_and_matches_brute_force():
    groups = {("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}
    flows, met = mi.routes(groups, {"a": 10.0, "b": 12.0}, {"a": 2, "b": 1})
    assert met == pytest.approx(22) and flows[("a", "b"), "b"] == pytest.approx(10) and flows[("a",), "a"] == pytest.approx(10)
    assert mi.routes(groups, {"a": 45.0, "b": 5.0}, {"a": 2, "b": 1})[1] == pytest.approx(45)
    assert mi.largest_total(groups, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}) == pytest.approx(24, rel=1e-3)


def test_texts_of_every_set_of_sources_flow_to_the_source_that_needs_them(spark):
    texts = [(f"shared text number {i} of several sources", "abcd"[:k]) for i, k in enumerate([2, 3, 4] * 20)]
    docs = [(100 * i + j, t, s) for i, (t, held) in enumerate(texts) for j, s in enumerate(held)]
    targets = [("a", 0.25, 1), ("b", 0.25, 1), ("c", 0.25, 1), ("d", 0.25, 1)]
    whole = mixed(spark, docs, targets)
    assert sum(r["tokens"] for r in whole[1]) == pytest.approx(4 * sum(r["tokens"] for r in whole[1] if r["source"] == "d"), rel=0.05)
    assert {r["doc_id"] for r in whole[0] if r["source"] == "d"} == {d for d, _, s in docs if s == "d"}
    key = lambda rows: sorted((r["doc_id"], r["repeats"]) for r in rows)
    assert key(mixed(spark, docs, targets, max_groups=1)[0]) == key(whole[0])
