"""Variant spellings of names typed by people.

Every distinct name is rewritten into its canonical forms by nickname, initial, legal-form and token-order rules, and
with one letter left out for typing errors. The forms are exploded and equi-joined; a pair that shares a form is scored
by how its parts agree and how rare the forms are. Linked names make one entity, whose seats are then paired.
"""

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.lexicon import COURTESY_TITLES, GIVEN_NAMES, NICKNAMES, WORD_NAMES
from loamworks.operators.lineage import cut

# Suffixes and credentials, particles, legal forms, words of organisations and their short forms.
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
SUFFIXES = frozenset("jr sr junior senior ii iii iv phd md mba cfa cpa esq jd ms msc bsc ma ba dds dvm cissp pmp pe rn obe cbe frs llm".split())
PARTICLES = frozenset("de van von der den la del della di da dos du le st".split())
LEGAL_FORMS = {"llc": "llc", "inc": "inc", "incorporated": "inc", "lp": "lp", "limitedpartnership": "lp", "gmbh": "gmbh", "ltd": "ltd", "limited": "ltd", "plc": "plc", "corp": "corp", "corporation": "corp", "llp": "llp", "ag": "ag", "sa": "sa", "nv": "nv", "bv": "bv", "co": "co", "company": "co"}
SHORT_FORMS = {"cap": "capital", "ptnrs": "partners", "ptnr": "partners", "fd": "fund", "mgmt": "management", "mgt": "management", "tr": "trust", "fam": "family", "pens": "pension", "vent": "ventures", "inv": "investment", "invs": "investments", "intl": "international", "assoc": "associates", "hldgs": "holdings", "grp": "group", "bk": "bank", "svcs": "services", "ins": "insurance", "adv": "advisors"}
ORGANISATION = frozenset("capital partners fund management trust ventures pension investment investments holdings group bank advisors advisers equity associates foundation endowment insurance asset assets".split())
_LOOKS = str.maketrans("015386", "olsebg")
_SPECIAL = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"})

_CANON: dict[str, frozenset] = {}
for _full, _short in NICKNAMES.items():
    for _n in _short.split():
        _CANON[_n] = _CANON.get(_n, frozenset()) | {_full}
KNOWN_GIVEN = GIVEN_NAMES | frozenset(NICKNAMES) | frozenset(_CANON) | WORD_NAMES


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL)) if not unicodedata.combining(ch))


_KNOWN = frozenset(plain(x) for x in KNOWN_GIVEN)


def given_forms(name: str) -> set:
    """A given name, the full names it may stand for and their short forms."""
    full = canonical_given(name)
    return {n for g in full for n in NICKNAMES.get(g, "").split()} | full


def canonical_given(name: str) -> frozenset:
    """The full names that a given name may stand for, itself among them."""
    return _CANON.get(name, frozenset()) | {name}


def parsed(raw: str | None) -> tuple[str, str, str, str, str] | None:
    """(kind, family, given, middle, generation) of a name as typed; an organisation has its core and, as middle, its legal form.

    Null and blank names and names without letters give None.
    """
    text = re.sub(r"\([^)]*\)", " ", raw or "")
    text = plain(re.sub(r"(?<=[^\W\d_])[015386](?=[^\W\d_])", lambda m: m.group().translate(_LOOKS), text)) if text.strip() else ""
    upper = (raw or "").strip()
    flat = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group().replace(".", "") + " ", text)
    words = re.findall(r"[a-z]+", flat.replace("'", "").replace("’", ""))
    if not words:
        return None
    tail = "".join(words[-2:]) if len(words) > 2 else ""
    full = [SHORT_FORMS.get(w, w) for w in words]
    squeezed = "".join(full)
    if set(full[1:]) & ORGANISATION or (words[-1] in LEGAL_FORMS and len(words) > 1 and words[-1] not in ("co", "sa", "ag")) or any(squeezed.endswith(x) for x in ("pensionfund", "capitalpartners", "familytrust", "investmentmanagement")):
        legal = ""
        if tail in LEGAL_FORMS:
            legal, full = LEGAL_FORMS[tail], full[:-2]
        elif full[-1] in LEGAL_FORMS:
            legal, full = LEGAL_FORMS[full[-1]], full[:-1]
        if full and full[-1] == "fund" and set(full[:-1]) & {"ventures", "partners", "management", "trust"}:
            full = full[:-1]
        return ("org", "".join(full), "", legal, "") if full else None
    text = re.sub(r"\b(?:ph\.?\s?d|m\.\s?d|m\.\s?s(?:c)?|b\.\s?s(?:c)?|j\.\s?d|m\.\s?b\.\s?a|ll\.\s?m)\b\.?", " ", text)
    parts = [p for p in text.replace("'", "").replace("’", "").split(",")]
    tokens = [[t for t in re.findall(r"[a-z]+", p)] for p in parts]
    lone = re.match(r"\s*(MS|MR|DR)\s+[^\W\d_]+(?:-[^\W\d_]+)*\W*$", upper)
    initials = lone.group(1).lower() if lone and (lone.group(1) == "MS" or upper != upper.upper()) else ""
    kept, generation = [], ""
    for i, p in enumerate(tokens):
        q = list(p)
        while q and q[0] in COURTESY_TITLES and q[0] != initials:
            q = q[1:]
        while q and q[-1] in SUFFIXES and (len(q) > 1 or i):
            generation = GENERATIONS.get(q[-1], generation)
            q = q[:-1]
        if q:
            kept.append(q)
    if not kept:
        return None
    if len(kept) >= 2:
        family, rest = kept[0], kept[1]
    else:
        q = kept[0]
        if len(q) == 1:
            return ("person", q[0], "", "", generation)
        k = 1
        while k < len(q) - 1 and (len(q[k]) == 1 or q[k] in _KNOWN):
            k += 1
        family, rest = q[k:], q[:k]
    family = [f for f in family if f not in PARTICLES] or family
    while rest and rest[-1] in PARTICLES:
        rest = rest[:-1]
    if not rest:
        return ("person", "".join(family), "", "", generation)
    given, middle = rest[0], "".join(x[0] for x in rest[1:] if x not in PARTICLES)
    if len(given) == 2 and (given not in _KNOWN or re.search(rf"\b{given.upper()}\b", upper) and upper != upper.upper()):
        given, middle = given[0], given[1] + middle
    return ("person", "".join(family), given, middle[:1], generation)


def rewritings(kind: str, family: str, given: str, middle: str) -> list[str]:
    """The canonical forms of a parsed name; names that may be the same share at least one."""
    shorter = {family} | ({family[:i] + family[i + 1 :] for i in range(len(family))} if len(family) >= 5 else set())
    if kind == "org":
        return sorted(f"o|{f}" for f in shorter)
    firsts = {g[0] for g in canonical_given(given)} if given else {""}
    for g in list(canonical_given(given)):
        firsts |= {n[0] for n in NICKNAMES.get(g, "").split()}
    forms = {f"p|{f}|{g}" for f in shorter for g in firsts}
    if len(given) > 1:
        forms |= {f"p|{family}|{given[1]}"}
        forms |= {f"e|{g}|{family[:3]}|{family[-3:]}" for g in canonical_given(given)} if len(family) >= 8 else set()
    return sorted(forms)


def shortened(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out; words within as many edits of each other share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def finer(tag: str, family: str, given: str) -> list[tuple[str, int]]:
    """(key, side) that split a form shared by very many names; names that agree share a key on sides that meet.

    Sides: 0 an initial, which meets all; 1 a name that meets initials only; 2 an exact form, 3 a form with letters left out
    of a known given name, which meets no other of that kind, 4 the same of another name. Names that agree with a name
    whose given name differs by typing errors are not both known.
    """
    if tag != "p":
        return [(f"f{x}", 4) for x in sorted(shortened(family, 2))]
    if len(given) <= 1:
        return [("", 0)]
    forms = given_forms(given)
    loose = {y for x in forms for y in shortened(x, 2 if len(x) >= 5 else 1)} - forms
    side = 3 if given in _KNOWN else 4
    return [("", 1), *((f"g{x}", 2) for x in sorted(forms)), *((f"g{x}", side) for x in sorted(loose))]


def distance(a: str, b: str, most: int) -> int:
    """Edits, neighbouring swaps counted as one, between two words; more than ``most`` comes out as ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


#: Points: of a pair's parts, of the bits by which a shared form is rarer than chance; a link needs STRONG in all.
SAME, NICKNAME, TYPO, INITIAL, STRONG = 6.0, 5.0, 3.5, 2.0, 8.0
#: Letters of the family name from which two typing errors in it are believed, of persons and of organisations.
LONG_FAMILY, LONG_CORE = 8, 10
#: Names that share a form, up to which they are compared as they are.
CROWD = 100


def agreement(a: tuple, b: tuple) -> tuple[str, float]:
    """How two parsed names agree: "full", "initial" or "" with points.

    Only the two names count, not how often they stand, so that a pair is judged alike in a table of any size.
    """
    kind, fa, ga, ma, na = a
    _, fb, gb, mb, nb = b
    gap = distance(fa, fb, 2)
    if na != nb or gap > 2:
        return "", 0.0
    if kind == "org":
        if ma and mb and ma != mb or gap > (2 if min(len(fa), len(fb)) >= LONG_CORE else 1):
            return "", 0.0
        return "full", SAME + 2.0 - 1.5 * gap
    if ma and mb and ma != mb or not ga or not gb:
        return "", 0.0
    if len(ga) == 1 or len(gb) == 1:
        one, other = (ga, gb) if len(ga) == 1 else (gb, ga)
        starts = {g[0] for g in canonical_given(other)} if len(other) > 1 else {other}
        short = {n[0] for g in canonical_given(other) for n in NICKNAMES.get(g, "").split()}
        return ("initial", INITIAL + 1.0 * bool(ma and mb) - 0.5 * (one not in starts) - gap) if one in starts | short and gap <= 1 else ("", 0.0)
    if ga == gb:
        points = SAME
    elif canonical_given(ga) & canonical_given(gb):
        points = NICKNAME
    elif ga in _KNOWN and gb in _KNOWN:
        return "", 0.0
    else:
        near = any(distance(x, y, 2) <= (2 if min(len(x), len(y)) >= 5 else 1) for x in given_forms(ga) for y in given_forms(gb))
        if not near or gap > 1:
            return "", 0.0
        points = TYPO
    if gap == 2 and not (points == SAME and min(len(fa), len(fb)) >= LONG_FAMILY):
        return "", 0.0
    return "full", points + 2.0 + 1.0 * bool(ma and mb) - 1.5 * gap


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, entity) of every node of ``edges`` (a, b): the least node of its connected component.

    Large-star and small-star rounds tie every node to the least of its neighbours until no edge moves; their number
    grows with the logarithm of the longest chain. A node's neighbours are never gathered: their least is aggregated, and
    joined back to the edges, one row a node.
    """
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(stars)
    while True:
        both = stars.union(stars.select("b", "a"))
        m = least(both).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        m = least(large)
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.union(m.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(stars)
        if after == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("entity")).union(stars.select("b", "b").distinct())
        before = after


def _entity_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, entity) of all nodes; a node without an edge is an entity of its own."""
    return cut(nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("entity", "node").alias("entity")))


def entities(seats: DataFrame, id_col: str = "id", name_col: str = "name", crowd: int = CROWD) -> DataFrame:
    """(member_id, name, entity) of every seat whose name can be read; seats of one entity are the same person or organisation.

    Rows that stand twice come once; null and blank names and names without letters have no entity. Names that differ
    only in case, accents, titles, credentials, order or spacing are one spelling; a name with initials only joins an
    entity if no other entity of that family fits it, and is left alone otherwise. A form that more than ``crowd`` names
    share is split by ``finer``, which loses no pair that agrees, so that a name meets as many others as agree with it
    and not all that have its family and initial.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *p, "|".join(p)) for n in b["name"] if (p := parsed(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "family", "given", "middle", "generation", "node"])

    seat = seats.select(F.col(id_col).cast("string").alias("member_id"), F.col(name_col).alias("name")).where("name is not null and member_id is not null").dropDuplicates(["member_id"])
    read = cut(seat.select("name").distinct().mapInPandas(parse, "name string, kind string, family string, given string, middle string, generation string, node string"))
    nodes = cut(read.select("node", "kind", "family", "given", "middle", "generation").distinct())

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, f) for n, k, fa, g, m in zip(b["node"], b["kind"], b["family"], b["given"], b["middle"], strict=True) for f in rewritings(k, fa, g, m)]
            yield pd.DataFrame(rows, columns=["node", "form"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, fo, df, x, side) for n, fo, t, df, fa, g in zip(b["node"], b["form"], b["tag"], b["df"], b["family"], b["given"], strict=True) for x, side in finer(t, fa, g)]
            yield pd.DataFrame(rows, columns=["node", "form", "df", "key", "side"])

    forms = nodes.select("node", "kind", "family", "given", "middle").mapInPandas(rewrite, "node string, form string").select("node", F.xxhash64("form").alias("form"), F.substring("form", 1, 1).alias("tag"))
    shared = cut(forms.join(forms.groupBy("form").agg(F.count("*").alias("df")).where("df > 1"), "form"))
    x, y = shared.where(F.col("df") <= crowd).alias("x"), shared.where(F.col("df") <= crowd).alias("y")
    pairs = x.join(y, (F.col("x.form") == F.col("y.form")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.df").alias("df"))
    split = shared.where(F.col("df") > crowd).join(nodes.select("node", "family", "given"), "node")
    split = cut(split.mapInPandas(refine, "node string, form bigint, df bigint, key string, side int").select("node", "df", "side", F.xxhash64("form", "key").alias("form")))
    x, y = split.alias("x"), split.alias("y")
    meet = F.least("x.side", "y.side") == 0
    meet = meet | (F.col("x.side") == 2) & (F.col("y.side") >= 2) | (F.col("y.side") == 2) & (F.col("x.side") >= 2) | (F.col("x.side") + F.col("y.side") >= 7)
    finer_pairs = x.join(y, (F.col("x.form") == F.col("y.form")) & (F.col("x.node") < F.col("y.node")) & meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.df").alias("df"))
    pairs = pairs.union(finer_pairs).groupBy("a", "b").agg(F.min("df").alias("df"))
    total = nodes.agg(F.count("*").alias("total"))
    known = nodes.select("node", F.struct("kind", "family", "given", "middle", "generation").alias("p"))
    sides = pairs.join(known.withColumnsRenamed({"node": "a", "p": "pa"}), "a").join(known.withColumnsRenamed({"node": "b", "p": "pb"}), "b").join(F.broadcast(total))
    rarity = F.log2(F.lit(2.0) + F.col("total")) - F.log2(F.col("df"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = ("kind", "family", "given", "middle", "generation")
        for b in batches:
            rows = []
            for x, y, p, q, bits in zip(b["a"], b["b"], b["pa"], b["pb"], b["rarity"], strict=True):
                how, points = agreement(tuple(p[x] for x in parts), tuple(q[x] for x in parts))
                if how:
                    rows.append((x, y, how, points, points + min(bits, 6.0)))
            yield pd.DataFrame(rows, columns=["a", "b", "how", "points", "score"])

    judged = cut(sides.select("a", "b", "pa", "pb", rarity.alias("rarity")).mapInPandas(judge, "a string, b string, how string, points double, score double"))
    full = judged.where((F.col("how") == "full") & (F.col("score") >= STRONG)).select("a", "b")
    full = _unambiguous(full, nodes)
    firm = _entity_of(nodes, full)
    ends = judged.where("how = 'initial'").select("a", "b", "points")
    ends = ends.union(ends.select("b", "a", "points")).toDF("short", "other", "points")
    brief = nodes.where("kind = 'person' and length(given) = 1").select(F.col("node").alias("short"))
    long = firm.join(nodes.where("length(given) <> 1").select("node"), "node").withColumnsRenamed({"node": "other", "entity": "to"})
    fits = ends.join(brief, "short").join(long, "other").groupBy("short", "to").agg(F.max("points").alias("points"))
    best = fits.groupBy("short").agg(F.max("points").alias("points"))
    fits = fits.join(best, ["short", "points"]).groupBy("short").agg(F.collect_set("to").alias("to")).where("size(to) = 1").select(F.col("short").alias("a"), F.col("to")[0].alias("b"))
    bound = ends.join(brief, "short").join(brief.withColumnRenamed("short", "other"), "other").select(F.col("short").alias("a"), F.col("other").alias("b"))
    alone = bound.join(ends.join(long, "other").select(F.col("short").alias("a")).distinct(), "a", "left_anti").join(ends.join(long, "other").select(F.col("short").alias("b")).distinct(), "b", "left_anti").select("a", "b")
    final = _entity_of(nodes, firm.where("node <> entity").toDF("a", "b").union(fits).union(alone))
    return seat.join(read.select("name", "node"), "name").join(final, "node").select("member_id", "name", "entity")


def _unambiguous(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges, but for those that tie a name without a middle initial to names with different ones."""
    middle = nodes.select(F.col("node").alias("far"), "middle")
    bare = nodes.where("kind = 'person' and middle = ''").select("node")
    around = edges.toDF("node", "far").union(edges.select("b", "a").toDF("node", "far")).join(bare, "node").join(middle, "far").where("middle <> ''")
    torn = cut(around.groupBy("node").agg(F.countDistinct("middle").alias("k")).where("k > 1").select("node"))
    with_middle = nodes.where("middle <> ''").select("node")
    cut_a = edges.join(torn.toDF("a"), "a", "left_semi").join(with_middle.toDF("b"), "b", "left_semi")
    cut_b = edges.join(torn.toDF("b"), "b", "left_semi").join(with_middle.toDF("a"), "a", "left_semi")
    return cut(edges.join(cut_a.select("a", "b").union(cut_b.select("a", "b")), ["a", "b"], "left_anti"))


def linked_pairs(seats: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(member_id_a, member_id_b): seats of one entity whose names are typed differently, the smaller id first."""
    one = cut(entities(seats, id_col, name_col))
    a, b = one.alias("a"), one.alias("b")
    on = (F.col("a.entity") == F.col("b.entity")) & (F.col("a.member_id") < F.col("b.member_id")) & (F.col("a.name") != F.col("b.name"))
    return a.join(b, on).select(F.col("a.member_id").alias("member_id_a"), F.col("b.member_id").alias("member_id_b"))
