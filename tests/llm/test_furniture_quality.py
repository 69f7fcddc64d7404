import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamworks.llm import furniture as fu
from loamworks.llm import quality as qu
from loamworks.llm.hashing import minima

CHUNKS = "id string, document_id string, content string, word_count int, site string, doc string, key string"
DOCS = "id string, ticker string, content string, site string"


def tables(spark, chunks, docs):
    rows = [(i, d, c, None, "s", "d", "k") for i, d, c in chunks]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(i, t, "c", "s") for i, t in docs], DOCS)


def site(n=6):
    docs = [(f"D{i}", " abc " if i % 2 else "ABC") for i in range(n)]
    chunks = [(f"c{i}", f"d{i} ", f"Own text number {'xyzuvw'[i]} is here.\nPage {i} of the  Filing!\n\n12 | 34") for i in range(n)]
    return chunks, docs


def test_lines_in_four_documents_come_out(spark):
    chunks, docs = site()
    got = {(r["chunk_id"], r["line_no"]) for r in fu.repeated_lines(*tables(spark, chunks, docs)).collect()}
    assert got == {(f"c{i}", 2) for i in range(6)}


def test_documents_not_chunks_are_counted(spark):
    chunks = [(f"c{i}", "d0", "Same line") for i in range(9)] + [("x1", "d1", "SAME LINE."), ("x2", "d2", "same-line 7"), ("y", "gone", "Same line"), ("z", None, "Same line")]
    docs = [("d0", "t"), ("d1", "t"), ("d2", "t"), ("d3", "u"), ("d4", None)]
    assert fu.repeated_lines(*tables(spark, chunks, docs)).count() == 0
    assert fu.repeated_lines(*tables(spark, chunks, docs), min_docs=3).count() == 11
    more = chunks + [("w", "d3", "Same line"), ("v", "d4", "Same line")]
    assert fu.repeated_lines(*tables(spark, more, docs), min_docs=4).count() == 0


def test_repeats_nulls_empty_and_long(spark):
    chunks, docs = site()
    long = "word " * 400_000
    more = chunks + chunks + [("n", "d1", None), ("e", "d1", ""), ("l", "d1", long + "\nPage of the filing"), (None, "d2", "Page of the filing")]
    got = [(r["chunk_id"], r["line_no"]) for r in fu.repeated_lines(*tables(spark, more, docs + docs)).collect()]
    assert sorted(got, key=str) == sorted({*[(f"c{i}", 2) for i in range(6)], ("l", 2), (None, 1)}, key=str)
    assert fu.repeated_lines(*tables(spark, [], [])).count() == 0
    assert fu.repeated_lines(*tables(spark, chunks, [])).count() == 0


def test_texts_without_the_lines(spark):
    chunks, docs = site()
    c, d = tables(spark, chunks + [("q", "d1", "alone\nand whole"), ("n", "d1", None)], docs)
    got = {r["chunk_id"]: (r["content"], r["n_removed"]) for r in fu.without_lines(c, fu.repeated_lines(c, d)).collect()}
    assert got["c0"] == ("Own text number x is here.\n\n12 | 34", 1) and got["q"] == ("alone\nand whole", 0) and got["n"] == (None, 0)


def test_masked_forms_cluster(spark):
    names = ["Mary", "Robert", "Linda", "David", "Susan"]
    chunks = [(f"c{i}", f"d{i}", f"By {n} Xylo{'abcde'[i]}, Investor Relations, March {i + 1}, 2024") for i, n in enumerate(names)]
    got = fu.line_clusters(*tables(spark, chunks, [(f"d{i}", "t") for i in range(5)])).collect()
    assert [(r["representative"], r["n_docs"]) for r in got] == [("byinvestorrelations", 5)]


@pytest.mark.parametrize(
    ("one", "other"),
    [("By John Smith, Staff Writer", "By JohnSmith, Staff Writer"), ("Forms may vary", "Formsmay vary"), ("M A Y", "May"), ("Zoë Q. Ábel, March 3", "ZoëQ Ábel Mar ch 4")],
)
def test_equal_letters_count_together_whatever_their_spacing(spark, one, other):
    chunks = [(f"c{i}", f"d{i}", f"Text {'abcdef'[i]} alone.\n{one if i < 3 else other}") for i in range(6)]
    got = {(r["chunk_id"], r["line_no"]) for r in fu.repeated_lines(*tables(spark, chunks, [(f"d{i}", "t") for i in range(6)])).collect()}
    assert got == {(f"c{i}", 2) for i in range(6)}


def test_equal_letters_are_counted_without_buckets_and_texts_read_once(spark, monkeypatch):
    def buckets(*args, **kwargs):
        raise AssertionError("no bucket of like lines bears on lines of equal letters")

    monkeypatch.setattr(fu, "crowded", buckets)
    read = spark.sparkContext.accumulator(0)

    def reading(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    chunks, docs = site()
    c, d = tables(spark, chunks, docs)
    got = {(r["chunk_id"], r["line_no"]) for r in fu.repeated_lines(c.mapInArrow(reading, CHUNKS), d).collect()}
    assert got == {(f"c{i}", 2) for i in range(6)} and read.value == len(chunks)


@settings(max_examples=150, deadline=None)
@given(st.text("aT .,\n\r\t-7\u00e9\u0130\u00df\u03a3\u03c3\u0301\u0660\u4e2d|'", max_size=60))
def test_letters_of_a_line_are_its_words_without_spacing(text):
    assert fu.letters_of(text) == ["".join(fu.words_of(line)).encode() for line in text.split("\n")]
    plain = text.encode("ascii", "ignore").decode()
    assert fu.letters_of(plain) == ["".join(fu.words_of(line)).encode() for line in plain.split("\n")]


def test_near_duplicate_lines_come_out_of_the_text(spark):
    names = ["Mary", "Robert", "Linda", "David", "Susan"]
    chunks = [(f"c{i}", f"d{i}", f"Own words {'pqrst'[i] * 9} here.\nBy {n} Xylo{'abcde'[i]}, Investor Relations, March {i + 1}, 2024") for i, n in enumerate(names)]
    c, d = tables(spark, chunks + chunks[:1] + [("n", "d0", None)], [(f"d{i}", "t") for i in range(5)])
    assert fu.repeated_lines(c, d).count() == 0
    near = fu.near_duplicate_lines(c, d)
    assert {tuple(r) for r in near.collect()} == {(f"c{i}", 2) for i in range(5)}
    assert fu.near_duplicate_lines(c, d, min_docs=6).count() == 0 and fu.near_duplicate_lines(*tables(spark, [], [])).count() == 0
    assert {r["chunk_id"]: r["n_removed"] for r in fu.without_lines(c, near).collect()} == {**{f"c{i}": 1 for i in range(5)}, "n": 0}


def bands_of(lines):
    m = minima([x.replace(" ", "").encode() for x in lines], fu.WIDTH, fu._SEEDS)
    return [{(j, *row[j * fu.ROWS : (j + 1) * fu.ROWS].tolist()) for j in range(fu.BANDS)} for row in m]


@pytest.mark.parametrize("heads", [1, 32])
def test_a_rarer_line_is_not_lost_to_an_unlike_commoner_one_in_one_of_its_buckets(spark, monkeypatch, heads):
    monkeypatch.setattr(fu, "HEADS", heads, raising=False)
    common = "notice to all readers of this filing seen on our pages"
    words = "kappa lambda sigma omega theta delta gamma zeta".split()
    rare = [f"notice to all readers of this filing {a} {b}" for a in words for b in words]
    bands = bands_of([common, *rare])
    line = next(x for x, b in zip(rare, bands[1:], strict=True) if len(b & bands[0]) == 1)
    chunks = [(f"a{i}", f"d{i}", common) for i in range(8)] + [(f"b{i}", f"d{i}", line + " x" * (i == 4)) for i in range(5)]
    got = {r["representative"]: (r["n_docs"], r["n_forms"]) for r in fu.line_clusters(*tables(spark, chunks, [(f"d{i}", "t") for i in range(8)])).collect()}
    assert got == {common.replace(" ", ""): (8, 1), line.replace(" ", ""): (5, 2)}


def test_minima_agree_with_one_by_one_and_estimate_similarity():
    seeds = np.random.default_rng(1).integers(1, 2**63, 400, dtype=np.uint64)
    a, b = b"the quick brown fox jumps over the lazy dog again", b"the quick brown fox jumps over the lazy cat again"
    both = minima([a, b"x", b], 12, seeds)
    assert (both[0] == minima([a], 12, seeds)[0]).all() and (both[2] == minima([b], 12, seeds)[0]).all()
    x, y = ({s[i : i + 12] for i in range(len(s) - 11)} for s in (a, b))
    assert abs((both[0] == both[2]).mean() - len(x & y) / len(x | y)) < 0.08


PROSE = "The committee has reviewed the plan for the next year and it was approved by all of the members of the board."
TABLE = "\n".join(f"| Item {i} | {i * 7}.5 | ${i},000 | (12) |" for i in range(12))


def stats(spark, rows, furniture=None, piece=qu.PIECE):
    t = spark.createDataFrame([(i, c, w, "x", 1) for i, c, w in rows], "id string, content string, word_count int, aside string, at int")
    return qu.text_statistics(t, furniture, piece)


def kinds(spark, rows, furniture=None):
    return {(r["chunk_id"], r["finding"]) for r in qu.findings(stats(spark, rows, furniture)).collect()}


FIELDS = [f.split()[0] for f in qu.PIECE_STATE.split(", ")]


def in_pieces(text, sizes, aside=frozenset()):
    """COUNTS of a text that is cut into pieces of the given sizes, in turn."""
    states, at = [], 0
    while at < len(text) or not states:
        n = sizes[len(states) % len(sizes)]
        states.append(dict(zip(FIELDS, qu.piece_state(len(states), text[at : at + n], False), strict=True)))
        at += n
    return qu.merged(states[::-1], aside)


def whole(text, aside=frozenset()):
    return qu.merged([dict(zip(FIELDS, qu.piece_state(0, text, True), strict=True))], aside)


@settings(max_examples=150, deadline=None)
@given(st.text("aT .,\n\r\t-the of\u00e9\u00a0\u0130x9", max_size=120), st.lists(st.integers(1, 40), min_size=1, max_size=4), st.frozensets(st.integers(1, 6)))
def test_every_count_is_the_same_wherever_a_text_is_cut(text, sizes, aside):
    assert in_pieces(text, sizes, aside) == whole(text, aside)


@pytest.mark.parametrize("size", [1, 2, 7, 10, 24, 50])
def test_every_count_of_prose_is_the_same_in_pieces(size):
    text = " \n".join([PROSE, TABLE, " x  y ", "", "Alpha beta of gamma delta epsilon zeta eta", PROSE]) + "\r\nend."
    assert in_pieces(text, [size]) == whole(text)
    assert whole(text)[2] == len(text.split()) and whole(text)[5] == sum(bool(x.strip()) for x in text.split("\n"))


def test_prose_however_it_is_set():
    wrapped = PROSE.replace("reviewed", "reviewed\n").replace("approved", "approved\n")
    for text in (PROSE, PROSE.upper(), PROSE.lower(), wrapped, "- " + PROSE, "*** " + PROSE + " ***"):
        got = whole(text)
        assert got[7] > got[8], text
    junk = ["2UQDBtry+HA5hQepKBGytUexULBhBQFKcPOUzEzLz6nC", "=~= ><<//<^<*~~>*%#_/+%*#@ + +=~*<%", "best cloud ai platform best ai cloud platform", "10.1 Alpha Beta charter\n10.2 Gamma Delta bond", "Alpha,2024,2023\nBeta,5,7"]
    for text in [TABLE, *junk]:
        got = whole(text)
        assert got[8] > got[7], text


def test_findings(spark):
    n = len(PROSE.split())
    rows = [("a", PROSE, n), ("b", PROSE, n + n // 2), ("c", TABLE, None), ("d", TABLE + "\n" + PROSE * 9, None), ("e", None, 3), ("f", "", None), ("g", None, None), ("b", PROSE, n + n // 2)]
    assert kinds(spark, rows) == {("b", "word_count"), ("c", "not_prose"), ("e", "word_count")}


def test_furniture_is_set_aside(spark):
    rows = [("a", "A1b2C3d4E5f6G7h8\n" + PROSE, None)]
    assert kinds(spark, rows) == set()
    assert kinds(spark, rows, spark.createDataFrame([("a", 2)], "chunk_id string, line_no bigint")) == {("a", "not_prose")}


@pytest.mark.parametrize("piece", [1, 2, 7, 50])
def test_pieces_add_up(spark, piece):
    text = " \n".join([PROSE, TABLE, " x  y ", ""]) + "\r\nend."
    whole, cut = stats(spark, [("a", text, 5)]).first(), stats(spark, [("a", text, 5)], piece=piece).first()
    assert whole["n_words"] == len(text.split()) and whole["n_chars"] == len(text)
    assert whole == cut


def test_empty_table(spark):
    assert stats(spark, []).count() == 0
