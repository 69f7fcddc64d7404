"""Several values packed in one field.

Dictionary-guided segmentation. A first pass learns whole values from fields whose notation leaves no doubt (lists in
brackets, quoted values, strong separators). In the second, an Aho-Corasick automaton marks where such values stand,
and dynamic programming picks the cover of the field that keeps them whole and else cuts at every separator in force.
"""

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.lineage import cut as written

# Marks for "nothing", credentials and suffixes that belong to the name before them.
NOTHING = {"", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "-", "--", "---", "–", "—", "[]", "{}", "not applicable", "nothing"}
CREDENTIAL = re.compile(r"^(ph\.?\s?d|m\.?\s?d|m\.?\s?s|m\.?\s?sc|b\.?\s?s|b\.?\s?a|m\.?\s?a|b\.?\s?sc|mba|m\.?b\.?a|j\.?\s?d|ll\.?\s?m|ll\.?\s?b|d\.?\s?phil|sc\.?\s?d|ed\.?\s?d|dr|cfa|cpa|cissp|pmp|cisa|cism|p\.?\s?e|r\.?\s?n|esq|esquire|jr|sr|junior|senior|ii|iii|iv|v|obe|cbe|mbe|kbe|frs)\.?$", re.I)
STRONG = re.compile(r"[;|\r\n]|(?<=\s)/(?=\s)")
MARK = re.compile(r"^\s*(?:[-*•·–—‣▪●◦]\s+|[•·▪●◦]|\(?\d{1,3}[.)]\s+)")
AND = re.compile(r"\s+and\s+", re.I)

#: Whole values in the dictionary: seen at least so often; at most so many (the most frequent) are broadcast, the others are joined.
MIN_SUPPORT, MAX_ENTRIES = 2, 50_000


@dataclass(frozen=True)
class PackedField:
    """A list-valued text column of a table; ``names`` if its values are names of persons."""

    table_name: str
    field_name: str
    names: bool = False
    id_col: str = "id"


def is_nothing(v: str) -> bool:
    """Whether a value is blank, only separators, or a mark for nothing."""
    return not v.strip(" ,;|/") or v.lower() in NOTHING


def protected(s: str) -> list[bool]:
    """Of each character, whether quotes or parentheses enclose it. Quotes and parentheses without a partner enclose nothing."""
    out = [False] * len(s)
    quote, opened, parens, i = "", 0, [], 0
    even = len(re.findall(r'(?<!\\)"', s)) % 2 == 0
    start = True
    while i < len(s):
        ch = s[i]
        if quote:
            if ch == "\\" and i + 1 < len(s):
                i += 2
                continue
            ends = ch == quote and (quote == '"' or re.match(r"\s*($|[,;|\]\r\n)}]|/\s)", s[i + 1 :]))
            if ends:
                out[opened : i + 1] = [True] * (i + 1 - opened)
                quote = ""
        elif ch == '"' and even:
            quote, opened = ch, i
        elif ch == "'" and start and re.search(r"'\s*($|[,;|\]\r\n)}]|/\s)", s[i + 1 :]):
            quote, opened = ch, i
        elif ch == "(":
            parens.append(i)
        elif ch == ")" and parens:
            j = parens.pop()
            out[j : i + 1] = [True] * (i + 1 - j)
        if not ch.isspace():
            start = ch in ",;|[/{"
        i += 1
    return out


def unquoted(v: str) -> str:
    """A value without bullets, numbering, outer quotes, escapes and surrounding spaces."""
    v = MARK.sub("", v.strip(), count=1).strip()
    for q in "\"'":
        if len(v) >= 2 and v[0] == q and v[-1] == q:
            inner = v[1:-1]
            if q not in inner.replace(q * 2, "").replace("\\" + q, ""):
                return re.sub(r"\\(.)", r"\1", inner.replace(q * 2, q)).strip()
    return v.replace('\\"', '"').strip()


def _opened(s: str, names: bool) -> tuple[tuple[list[str], bool] | None, str, list[tuple[int, int]], bool, bool]:
    """What ``segments`` returns for a JSON list or a field without values, else None; the text, its cuts, whether they are strong, whether it is a list."""
    t = (s or "").strip()
    listed = False
    if t[:1] in "[{" and t[-1:] == {"[": "]", "{": "}"}.get(t[:1]):
        try:
            got = json.loads(t)
            if isinstance(got, list) and all(x is None or isinstance(x, (str, int, float)) for x in got):
                return ([v for x in got if x is not None and not is_nothing(v := str(x).strip())], True), t, [], False, True
        except ValueError:
            pass
        t, listed = t[1:-1], True
    if is_nothing(t):
        return ([], False), t, [], False, listed
    safe = protected(t)
    strong = [m.span() for m in STRONG.finditer(t) if not safe[m.start()]]
    cuts = strong or [(i, i + 1) for i, ch in enumerate(t) if ch == "," and not safe[i]]
    if names and not listed:
        ends = [a for a, _ in cuts] + [len(t)]
        tail = max((b for b, e in zip([0] + [b for _, b in cuts], ends, strict=True) if t[b:e].strip() and not CREDENTIAL.match(t[b:e].strip())), default=0)
        joint = [m for m in AND.finditer(t, max(0, tail - 1)) if not safe[m.start() + 1]]
        lead = re.match(r"\s*and\s+", t[tail:], re.I)
        if lead and tail:
            cuts = sorted({*cuts, (tail, tail + lead.end())})
        elif joint:
            cuts = sorted({*cuts, joint[-1].span()})
    return None, t, cuts, bool(strong), listed


def segments(s: str, names: bool, find=None) -> tuple[list[str], bool]:
    """The values of a field in order, and whether the notation left no doubt.

    ``find(text)`` yields (start, end, support) of known whole values in ``text``. Null, blank and "nothing" fields
    have no value; a very long field is one pass over its characters and as many steps as it has separators.
    """
    whole, t, cuts, strong, listed = _opened(s, names)
    if whole is not None:
        return whole
    known: dict[tuple[int, int], int] = {}
    if find is not None and not strong and cuts:
        known = {(a, b): n for a, b, n in find(t)}
    pieces = _cover(t, cuts, known)
    values: list[str] = []
    for p in pieces:
        if names and values and CREDENTIAL.match(p.strip()) and not strong:
            values[-1] = f"{values[-1].rstrip()}, {p.strip()}"
        else:
            values.append(p)
    return [v for x in values if not is_nothing(v := unquoted(x))], bool(strong or listed or '"' in t)


def candidates(s: str, names: bool, longest: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-cased text) of what stands from cut to cut, over at least one cut, in at most ``longest`` characters."""
    whole, t, cuts, strong, _ = _opened(s, names)
    if whole is not None or strong or len(t) != len(t.lower()):
        return
    starts, ends = [0] + [b for _, b in cuts], [a for a, _ in cuts] + [len(t)]
    for i, a in enumerate(starts):
        for b in ends[i + 1 :]:
            v = t[a:b].strip()
            if len(v) > longest:
                break
            at = a + len(t[a:b]) - len(t[a:b].lstrip())
            yield at, at + len(v), v.lower()


def _cover(t: str, cuts: list[tuple[int, int]], known: Mapping[tuple[int, int], int]) -> list[str]:
    """The best cover: every cut is made, but for those inside a known whole value."""
    starts, ends = [0] + [b for _, b in cuts], [a for a, _ in cuts] + [len(t)]
    if not known:
        return [t[a:b] for a, b in zip(starts, ends, strict=True)]
    at = {}
    for a, b in known:
        i = next((k for k, x in enumerate(starts) if t[x:a].strip() == "" and x <= a), None)
        j = next((k for k, x in enumerate(ends) if x >= b and t[b:x].strip() == ""), None)
        i = max((k for k, x in enumerate(starts) if x <= a), default=None) if i is None else max(k for k, x in enumerate(starts) if x <= a)
        if j is not None and t[starts[i] : a].strip() == "" and j > i:
            at.setdefault(j, []).append((i, known[a, b]))
    best: list[tuple[float, int]] = []
    for j in range(len(ends)):
        options = [((best[j - 1][0] if j else 0.0), j)]
        options += [((best[i - 1][0] if i else 0.0) + 1 + n / (1 + n), i) for i, n in at.get(j, [])]
        best.append(max(options, key=lambda o: (o[0], o[1])))
    out, j = [], len(ends) - 1
    while j >= 0:
        i = best[j][1]
        out.append(t[starts[i] : ends[j]])
        j = i - 1
    return out[::-1]


def _long(tables: Mapping[str, DataFrame], fields: Sequence[PackedField]) -> DataFrame:
    """All packed fields as rows (table_name, row_id, field_name, names, value); rows that stand twice come once."""
    parts = [
        tables[f.table_name].where(F.col(f.field_name).isNotNull()).select(F.lit(f.table_name).alias("table_name"), F.col(f.id_col).cast("string").alias("row_id"), F.lit(f.field_name).alias("field_name"), F.lit(f.names).alias("names"), F.col(f.field_name).alias("value"))
        for f in fields
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["table_name", "row_id", "field_name"])


def segment_dictionary(tables: Mapping[str, DataFrame], fields: Sequence[PackedField], min_support: int = MIN_SUPPORT) -> DataFrame:
    """(field_name, item, support): whole values that hold a separator, from fields whose notation leaves no doubt."""

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, names, value in zip(b["field_name"], b["names"], b["value"], strict=True):
                got, sure = segments(value, names)
                if sure:
                    out += [(name, v) for v in got if "," in v or re.search(r"\sand\s", v)]
            yield pd.DataFrame(out, columns=["field_name", "item"])

    values = _long(tables, fields).select("field_name", "names", "value").mapInPandas(known, "field_name string, item string")
    return values.groupBy("field_name", "item").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def _joined(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, hits): where whole values of the dictionary stand in the fields, by an equi-join."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [v.lower() for v in b["item"]]
            yield pd.DataFrame({"field_name": b["field_name"], "key": keys, "n": [len(k) for k in keys], "support": b["support"]})

    known = written(dictionary.mapInPandas(keyed, "field_name string, key string, n int, support bigint").groupBy("field_name", "key", "n").agg(F.min("support").alias("support")))
    longest = {r["field_name"]: r["n"] for r in known.groupBy("field_name").agg(F.max("n").alias("n")).collect()}  # one row a field

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(tn, rid, fn, *c) for tn, rid, fn, names, value in zip(b["table_name"], b["row_id"], b["field_name"], b["names"], b["value"], strict=True) for c in candidates(value, names, longest.get(fn, 0))]
            yield pd.DataFrame(out, columns=["table_name", "row_id", "field_name", "a", "b", "key"])

    stands = rows.mapInPandas(spans, "table_name string, row_id string, field_name string, a int, b int, key string")
    return stands.join(known, ["field_name", "key"]).groupBy("table_name", "row_id", "field_name").agg(F.collect_list(F.struct("a", "b", "support")).alias("hits"))


def unpack(tables: Mapping[str, DataFrame], fields: Sequence[PackedField], min_support: int = MIN_SUPPORT, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(table_name, row_id, field_name, pos, item, n_items): one row per value, ``pos`` from 1 over values that are not blank.

    Null and blank fields and empty tables give no row; repeated values keep their own positions. The
    ``max_entries`` most frequent whole values are broadcast; all others are equi-joined with the candidates of each field.
    """
    spark = next(iter(tables.values())).sparkSession
    dictionary, rows = segment_dictionary(tables, fields, min_support), _long(tables, fields)
    order = [F.desc("support"), "field_name", "item"]
    top = dictionary.orderBy(*order).limit(max_entries + 1).collect()  # at most max_entries and one
    hits = F.lit(None).cast("array<struct<a:int,b:int,support:bigint>>").alias("hits")
    if len(top) > max_entries:
        rows = written(rows)
        found = _joined(rows, written(dictionary)).toDF("t", "r", "f", "hits")
        rows = rows.join(found, (F.col("table_name") == F.col("t")) & F.col("row_id").eqNullSafe(F.col("r")) & (F.col("field_name") == F.col("f")), "left")
        hits = F.col("hits")
    rows = rows.select("table_name", "row_id", "field_name", "names", "value", hits)
    entries = [(r["field_name"], r["item"].lower(), r["support"]) for r in top[:max_entries]]
    shared = spark.sparkContext.broadcast(entries)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automata = {}
        for name, item, support in shared.value:
            automata.setdefault(name, ahocorasick.Automaton()).add_word(item, (len(item), support))
        for a in automata.values():
            a.make_automaton()

        def finder(name: str):
            auto = automata.get(name)
            return None if auto is None else lambda t: ((e + 1 - n, e + 1, s) for e, (n, s) in auto.iter(t.lower()) if len(t) == len(t.lower()))

        find = {f.field_name: finder(f.field_name) for f in fields}
        for b in batches:
            out = []
            for tn, rid, fn, names, value, hits in zip(b["table_name"], b["row_id"], b["field_name"], b["names"], b["value"], b["hits"], strict=True):
                more = [] if hits is None else [(h["a"], h["b"], h["support"]) for h in hits]
                auto = find[fn]
                got, _ = segments(value, names, (lambda t, auto=auto, more=more: [*(auto(t) if auto else ()), *more]) if auto or more else None)
                out += [(tn, rid, fn, k, v, len(got)) for k, v in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["table_name", "row_id", "field_name", "pos", "item", "n_items"])

    return rows.mapInPandas(cut, "table_name string, row_id string, field_name string, pos int, item string, n_items int")
