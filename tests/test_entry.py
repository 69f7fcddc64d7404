import os
import re

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
CORE = sorted(n for n, f in __spark_entry__.queries().items() if not f.__module__.startswith("loamworks.llm"))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return "None"
    return repr(round(v, 5)) if isinstance(v, float) else str(v)


def _numbered(got, keys, number, first):
    """The numbers of each key count up from ``first`` without a gap."""
    assert len(got)
    for _, g in got.groupby(keys, dropna=False):
        assert sorted(g[number]) == list(range(first, first + len(g)))


def _texts():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' where text is not null").fetchall())


def _document_chunks(got):
    texts = _texts()
    _numbered(got, ["doc_id"], "chunk_index", 0)
    assert (got["word_count"] <= 120).all() and set(got["doc_id"]) == {d for d, t in texts.items() if t.strip()}
    for r in got.itertuples():
        assert r.start_char is None or r.start_char != r.start_char or texts[r.doc_id][int(r.start_char) :].startswith(r.content)
    for d, g in got.groupby("doc_id"):
        assert set(texts[d].split()) == {w for c in g["content"] for w in c.split()}


def _memo_sections(got):
    texts = _texts()
    for d, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g["end"]) == [*g["start"][1:], len(texts[d])] and (g["start"].diff().dropna() >= 100).all()


def _packed(got):
    _numbered(got, ["table_name", "row_id", "field_name"], "pos", 1)
    assert (got["item"].str.strip() == got["item"]).all() and (got["item"] != "").all()
    assert (got.groupby(["table_name", "row_id", "field_name"]).size() >= 2).all()


def _dictionary(got):
    assert (got["support"] >= 2).all() and not got.duplicated(["field_name", "item"]).any()
    assert got["item"].map(lambda v: "," in v or " and " in v.lower()).all()


def _section_chunks(got):
    texts = _texts()
    _numbered(got, ["doc_id"], "chunk_index", 0)
    assert (got["n_words"] <= 240).all()
    for r in got.dropna(subset=["start"]).itertuples():
        assert len(texts[r.doc_id][int(r.start) : int(r.end)].split()) == r.n_words


HOLDS = {"document_chunks": _document_chunks, "memo_sections": _memo_sections, "p6_found": _packed, "p6_dictionary": _dictionary, "section_chunks": _section_chunks}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_matches_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert name in HOLDS, "a query without SQL needs a check of its own"
        HOLDS[name](got)
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_outside_imports_the_training_text_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "loamworks")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"loamworks\.llm", open(os.path.join(folder, f)).read())
