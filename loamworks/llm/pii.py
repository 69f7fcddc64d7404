"""Personal information inside free text.

Weak-supervision aggregation: regular expressions, gazetteers and context labelers vote on candidate spans. The votes are
counted over the whole corpus; expectation-maximisation over these counts estimates how far each labeler is to be
trusted and gives every vote pattern a probability. The context labelers are learned: the words beside spans that the other
labelers trust, or do not, vote in a second estimate. A logistic span classifier, fitted to the probabilities on a
bounded sample of spans, decides. Texts are read once; what follows works on their spans.
"""

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.lexicon import COURTESY_TITLES, GIVEN_NAMES, NICKNAMES, WORD_NAMES
from loamworks.llm.quality import COMMON_WORDS
from loamworks.operators.lineage import cut, spread

TYPES = ("email", "id_number", "phone", "address", "name")
#: Spans the classifier is fitted on, at most; buckets of its word features; probability from which a span is replaced.
MAX_SAMPLE, BUCKETS, THRESHOLD = 50_000, 4096, 0.5
#: Weight of the belief that a labeler is right more often than not, in spans.
PRIOR = 10

GAZETTEER = GIVEN_NAMES | frozenset(x for v in NICKNAMES.values() for x in v.split()) | WORD_NAMES

# Forms of addresses, phone numbers, identity numbers and street addresses.
_AT = r"(?:\s*@\s*|\s*[\(\[{<]\s*(?:at|@|a)\s*[\)\]}>]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\(\[{<]\s*(?:dot|\.)\s*[\)\]}>]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:(?:{_DOT})[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*", re.I)
_EMAIL_PLAIN = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", re.I)
_EMAIL_SPELT = re.compile(rf"(?<![\w.+-])[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}\b(?!{_AT}[\w-]+{_DOT})", re.I)
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_DIGIT = rf"(?:{_DIGIT_WORD}|\d)"
_SPELT_DIGITS = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s,-]*)?(?=(?:\d[\s,.-]*)*{_DIGIT_WORD}\b){_DIGIT}(?:[\s,.-]+(?:(?:double|triple)\s+)?{_DIGIT}){{6,}}(?!\w)", re.I)
_SPELT = re.compile(rf"\b{_DIGIT_WORD}[\s,.-]+(?:(?:double|triple)\s+)?{_DIGIT}\b")
_DODGED_AT = re.compile(r"[\s\(\[{<]at[\s\)\]}>]")
_PHONE = re.compile(r"(?<![\w$#.-])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,5}\)[\s.-]?|\d)[\d\s.()-]{6,17}\d(?![\w-]*\d|[\w%])")
_PHONE_FORMS = [
    re.compile(r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-]?)\d{3}[\s.-]?\d{4}"),
    re.compile(r"\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,7}"),
    re.compile(r"0\d{1,4}[\s.-]\d{2,4}(?:[\s.-]\d{2,5}){1,4}"),
]
_ID_LABEL = r"(?:ssn|s\.s\.n\.?|social(?:\s+security)?(?:\s+(?:number|no\.?|num))?|national\s+insurance(?:\s+(?:number|no\.?))?|n\.?i\.?(?:\s+(?:number|no\.?))|nino|tax(?:payer)?\s+(?:id|number|no\.?|identification)(?:\s+number)?|tin|passport(?:\s+(?:number|no\.?|num|#))?|driv(?:er'?s?|ing)'?\s+licen[cs]e(?:\s+(?:number|no\.?|#))?|licen[cs]e\s+(?:number|no\.?)|identity\s+(?:card|number)(?:\s+(?:number|no\.?))?)"
_ID = re.compile(rf"\b{_ID_LABEL}\s*(?:is|was|#|:|=)?\s*[A-Z]{{0,3}}[\s-]?\d(?:[\s-]?\d){{4,11}}(?:\s?[A-Z])?\b|(?<![\w.-])\d{{3}}([-. ])\d{{2}}\1\d{{4}}(?![\w-])|(?<!\w)[A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]\b|\b{_ID_LABEL}\s*(?:is|was)?\W{{0,3}}{_DIGIT_WORD}(?:[\s,.-]+{_DIGIT_WORD}){{5,}}", re.I)
_ID_LABELLED = re.compile(rf"\b{_ID_LABEL}\b", re.I)
_ID_FORMS = [re.compile(r"\d{3}-\d{2}-\d{4}$"), re.compile(r"(?:^|\s)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]$", re.I), re.compile(r"[A-Z]{1,2}\d{6,9}$"), re.compile(r"\d{3}[ -]?\d{2}[ -]?\d{4}$")]
_STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way|place|pl|terrace|square|sq|parkway|pkwy|highway|hwy|circle|cir|crescent)"
_TAIL = r"(?:,?\s+(?:apt|unit|suite|ste|flat|no)\.?\s*\d+\w?|,?\s*#\s?\d+\w?)?(?:,\s*(?-i:[A-Z])[\w'’-]+(?:\s+\d{4,5})?)?"
_ADDRESS = re.compile(
    rf"(?:\b(?:unit|apt|suite|flat)\.?\s+\d+\w?,\s*)?\b\d{{1,6}}[a-z]?\s+(?:(?:[NSEW]|NE|NW|SE|SW|north|south|east|west|old|new|upper|lower)\.?\s+)?(?:[^\W\d_][\w'’-]*\s+){{1,2}}{_STREET}\b\.?{_TAIL}"
    r"|\bp\.?\s?o\.?\s*box\s+\d+(?:,\s*(?-i:[A-Z])[\w'’-]+)?|\bpost\s+office\s+box\s+\d+(?:,\s*(?-i:[A-Z])[\w'’-]+)?"
    r"|\b[^\W\d_]+(?:straße|strasse|str\.|gasse|allee|platz|weg)\s+\d{1,4}[a-z]?(?:,\s*\d{4,5}\s+[^\W\d_]+)?"
    r"|\b\d{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|boulevard|chemin|quai|impasse|allée)\s+(?:de\s+|du\s+|des\s+|la\s+)*[^\W\d_][\w'’-]*(?:,\s*[^\W\d_][\w'’-]*)?"
    r"|\b(?:calle|avenida|paseo|plaza)\s+(?:de\s+)?[^\W\d_][\w'’-]*,?\s+\d{1,4}(?:,\s*[^\W\d_]+)?",
    re.I,
)
_THING = re.compile(r"\b(?:team|group|crew|policy|project|program|department|division|company|inc|corp|systems|street)\b", re.I)
_THING_NEXT = re.compile(r"^[\s,]*(?:team|group|crew|policy|project|program|department|division|company|systems?|street|office|site|tools?)\b", re.I)
#: Spans of a type that a context word must stand beside, as a share of them, and how far it must shift the odds to vote.
LEAST_SHARE, SHIFT = 1e-3, 1.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    left: str
    right: str


def _email_votes(s: str, right: str) -> tuple[int, ...]:
    plain, spelt = _EMAIL_PLAIN.fullmatch(s), _EMAIL_SPELT.fullmatch(s)
    return (1 if plain else 0, 1 if spelt and (not plain) else 0 if plain else -1, 0 if plain or spelt else -1, -1 if not plain and " at " in s.lower() and " dot " not in s.lower() and "." not in s else 0)


def _phone_votes(s: str, right: str) -> tuple[int, ...]:
    spelt = bool(_SPELT_DIGITS.fullmatch(s))
    digits = sum(ch.isdigit() for ch in s) + spelt * len(re.findall(_DIGIT_WORD, s, re.I))
    form = spelt or any(p.fullmatch(s) for p in _PHONE_FORMS)
    return (1 if form else -1, 1 if 10 <= digits <= 13 else -1, 1 if re.match(r"\s*(?:ext|x)\b", right, re.I) else 0)


def _id_votes(s: str, right: str) -> tuple[int, ...]:
    return (1 if any(p.search(s) for p in _ID_FORMS) else -1, 1 if _ID_LABELLED.search(s) else 0, 1 if re.fullmatch(r"\d{3}([-. ])\d{2}\1\d{4}", s) else 0)


def _address_votes(s: str, right: str) -> tuple[int, ...]:
    words = re.findall(r"[^\W\d_]+", s.lower())
    box = bool(re.match(r"p\.?\s?o|post", s, re.I))
    plain = any(w in COMMON_WORDS or w in _UNITS for w in words) and not box
    return (-1 if plain else 1, 1 if box or re.search(r",\s*(?:\d{4,5}\s+)?[A-Z]\w+|#\s?\d|\b(?:apt|unit)\b", s, re.I) else 0, 1 if re.search(r"[A-Z]", s) else 0)


_UNITS = frozenset("people minute minutes hour hours day days week weeks month months year years percent jobs reports meetings courses units miles km employees times steps more".split())


def _name_votes(s: str, right: str) -> tuple[int, ...]:
    words = re.findall(r"[^\W\d_]+", s)
    low = [w.lower() for w in words]
    titled = low[0] in COURTESY_TITLES and len(words) > 1
    full = [w for w in low if len(w) > 1 and w not in COURTESY_TITLES]
    known = any(w in GAZETTEER and w not in WORD_NAMES for w in full) and len(full) > 1
    wordlike = any(w in WORD_NAMES for w in full)
    initial = len(words[0]) == 1 and len(words) > 1
    caps = all(w[0].isupper() for w in words if w.lower() not in _PARTICLES)
    plain = any(w in COMMON_WORDS for w in full) or wordlike and not titled
    return (
        1 if titled else 0,
        1 if known else 0 if titled or initial or wordlike else -1,
        1 if initial and caps and len(full) == 1 else 0,
        1 if caps and len(full) > 1 else 0 if titled or known or initial else -1,
        -1 if _THING.search(s) or _THING_NEXT.match(right) else 0,
        -1 if plain else 0,
    )


_VOTES = {"email": _email_votes, "phone": _phone_votes, "id_number": _id_votes, "address": _address_votes, "name": _name_votes}


def _family(words: list, k: int, text: str) -> int | None:
    """The index of the family name that follows the given name or title at ``k``: past initials and particles, by spaces only."""
    j = k + 1
    while j < len(words):
        w, s, _ = words[j]
        gap = text[words[j - 1][2] : s]
        initial = len(words[j - 1][0]) == 1
        if not gap.strip(" \u00a0") in ("", "." if initial or words[j - 1][0].lower() in COURTESY_TITLES else "") or len(gap) > 3:
            return None
        if len(w) == 1 and j - k <= 3 or w.lower() in _PARTICLES:
            j += 1
            continue
        return j if len(w) >= 3 and w.lower() not in COMMON_WORDS else None
    return None


_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PARTICLES = frozenset("de van von der den la del di da dos st".split())


def _names(text: str) -> list[tuple[int, int]]:
    """Candidate names: a title or given name before a family name, a family name before ", given name", initials before one, and pairs of capitalised words."""
    words = [(m.group(), *m.span()) for m in _WORDS.finditer(text)]
    low = [w[0].lower() for w in words]
    out, k = [], 0
    while k < len(words):
        w, s, e = words[k]
        end = None
        if low[k] in COURTESY_TITLES and (j := _family(words, k, text)) is not None:
            end = j + 1 if j + 1 < len(words) and words[j + 1][0][0].isupper() and text[words[j][2] : words[j + 1][1]] == " " and (low[j] in GAZETTEER or len(words[j][0]) == 1) else j
        elif low[k] in GAZETTEER and (j := _family(words, k, text)) is not None and not (w[0].isupper() and words[j][0].islower() and k and text[words[k - 1][2] : s] == ", "):
            end = j
        elif k + 1 < len(words) and low[k + 1] in GAZETTEER and len(w) >= 3 and low[k] not in COMMON_WORDS and text[e : words[k + 1][1]] == ", ":
            j = _family(words, k + 1, text)
            if j is None or words[k + 1][0][0].isupper() and words[j][0][0].islower():
                end = k + 2 if k + 2 < len(words) and len(words[k + 2][0]) == 1 and text[words[k + 2][2] : words[k + 2][2] + 1] == "." else k + 1
        elif len(w) == 1 and w.isupper() and text[e : e + 1] == "." and (j := _family(words, k, text)) is not None and words[j][0][0].isupper():
            end = j
        elif k + 1 < len(words) and w[0].isupper() and words[k + 1][0][0].isupper() and len(w) > 1 and len(words[k + 1][0]) > 2 and text[e : words[k + 1][1]] == " " and not {low[k], low[k + 1]} & (GAZETTEER | COURTESY_TITLES | COMMON_WORDS):
            if not (k + 2 < len(words) and low[k + 2] in GAZETTEER and text[words[k + 1][2] : words[k + 2][1]] == ", "):
                end = k + 1
        if end is None:
            k += 1
        else:
            out.append((s, words[end][2]))
            k = end + 1
    return out


def candidates(text: str) -> list[Span]:
    """Candidate spans of a text with their votes; of overlapping ones the first type of TYPES stays."""
    taken: list[tuple[int, int]] = []
    out = []

    def add(kind: str, s: int, e: int) -> None:
        if any(s < b and a < e for a, b in taken):
            return
        left, right = text[max(0, s - 45) : s], text[e : e + 30]
        votes = _VOTES[kind](text[s:e], right)
        lw, rw = re.findall(r"[^\W\d_]+", left), re.findall(r"[^\W\d_]+", right)
        taken.append((s, e))
        out.append(Span(kind, s, e, votes, lw[-1].lower() if lw else "", rw[0].lower() if rw else ""))

    low = text.lower()
    if "@" in text:
        for m in _EMAIL_PLAIN.finditer(text):
            add("email", *m.span())
    if "@" in text or _DODGED_AT.search(low):
        for m in _EMAIL_SPELT.finditer(text):
            add("email", *m.span())
        for m in _EMAIL.finditer(text):
            if "@" in m.group() or re.search(r"[\(\[{<]\s*at", m.group(), re.I):
                add("email", *m.span())
    digits = any(ch.isdigit() for ch in text)
    spelt = _SPELT.search(low)
    if digits or spelt:
        for m in _ID.finditer(text):
            add("id_number", *m.span())
    if digits:
        for m in _ADDRESS.finditer(text):
            add("address", *m.span())
        for m in _PHONE.finditer(text):
            if sum(ch.isdigit() for ch in m.group()) >= 7:
                add("phone", *m.span())
    if spelt:
        for m in _SPELT_DIGITS.finditer(text):
            add("phone", *m.span())
    for span in _names(text):
        add("name", *span)
    return out


def reliabilities(counts: dict[str, dict[tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability of each (type, votes), by expectation-maximisation over counts of vote patterns.

    Each labeler has, for spans that are of the type and for others, its own chances of voting for, against or not at
    all; a labeler starts out as right more often than not.
    """
    out = {}
    for kind, patterns in counts.items():
        keys = list(patterns)
        n = np.array([patterns[k] for k in keys], float)
        v = np.array(keys, int) + 1
        p = 1 / (1 + np.exp(-1.5 * (np.array(keys).clip(-1, 1) * np.where(np.array(keys) < 0, 1.5, 1.0)).sum(1) + 0.75))
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            log = np.full((2, len(keys)), np.log([[1 - prior], [prior]]))
            for j in range(v.shape[1]):
                for c, w in enumerate((n * (1 - p), n * p)):
                    hits = np.bincount(v[:, j], w, 3) + np.array([[2.0, 2.0, 0.5], [0.5, 2.0, 2.0]])[c] * PRIOR
                    log[c] += np.log(hits / hits.sum())[v[:, j]]
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(p - q).max() < 1e-6:
                break
            p = q
        out |= {(kind, k): float(x) for k, x in zip(keys, p, strict=True)}
    return out


def _features(kind: str, votes: Sequence[int], left: str, right: str) -> list[int]:
    names = [f"{kind}", *(f"{kind}:{j}={v}" for j, v in enumerate(votes)), f"{kind}:votes={','.join(map(str, votes))}", f"{kind}<{left}", f"{kind}>{right}"]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def fit_classifier(rows: Sequence[tuple], target: dict, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights of span features, fitted to the probabilities of their vote patterns."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return weights
    width = max(len(r[1]) for r in rows) + 4
    x = np.full((len(rows), width), -1)
    for i, r in enumerate(rows):
        f = _features(r[0], r[1], r[2], r[3])
        x[i, : len(f)] = f
    used = x >= 0
    y, n = np.array([target[r[0], tuple(r[1])] for r in rows]), np.array([r[4] for r in rows], float)
    square = np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.where(used, weights[x], 0).sum(1)))
        g = np.bincount(x[used], np.broadcast_to(((p - y) * n)[:, None], x.shape)[used], BUCKETS) / n.sum() + ridge * weights
        square += g * g
        weights -= rate * g / np.sqrt(square)
    return weights


def _fields(reviews: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f")
    return spread(reviews.select(id_col, *fields)).select(F.col(id_col).cast("string").alias("row_id"), stacked).select("row_id", "f.field_name", "f.text").where("text is not null and trim(text) <> ''")


@dataclass(frozen=True)
class Judge:
    """What decides on a span: how far the words beside it shift the odds, by (type, side), and the weights of the classifier."""

    beside: dict[tuple[str, str], dict[str, float]]
    weights: np.ndarray

    def votes(self, kind: str, votes: Sequence[int], left: str, right: str) -> tuple[int, ...]:
        """The votes of the labelers of form, and that of the context labeler: whether the words on both sides shift the odds far enough."""
        shift = self.beside.get((kind, "left"), {}).get(left, 0.0) + self.beside.get((kind, "right"), {}).get(right, 0.0)
        return (*votes, 1 if shift >= SHIFT else -1 if shift <= -SHIFT else 0)

    def probability(self, kind: str, votes: Sequence[int], left: str, right: str) -> float:
        return float(1 / (1 + np.exp(-self.weights[_features(kind, self.votes(kind, votes, left, right), left, right)].sum())))


def candidate_spans(reviews: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """(row_id, field_name, kind, start, votes, left, right, h): the candidate spans of the fields; ``h`` is a hash that samples them."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, s.kind, s.start, list(s.votes), s.left, s.right, zlib.crc32(f"{i}{f}{s.start}".encode())) for i, f, t in zip(b["row_id"], b["field_name"], b["text"], strict=True) for s in candidates(t)]
            yield pd.DataFrame(rows, columns=["row_id", "field_name", "kind", "start", "votes", "left", "right", "h"])

    return _fields(reviews, fields, id_col).mapInPandas(votes, "row_id string, field_name string, kind string, start int, votes array<int>, left string, right string, h bigint")


def _counts(rows: DataFrame) -> dict[str, dict[tuple[int, ...], int]]:
    counts: dict = {}
    for r in rows.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():  # at most three outcomes a labeler
        counts.setdefault(r["kind"], {})[tuple(r["votes"])] = r["n"]
    return counts


def context_words(spans: DataFrame, counts: dict, sure: dict) -> dict[tuple[str, str], dict[str, float]]:
    """By (type, side), how far the words beside spans shift the log odds of the type.

    Words of at least LEAST_SHARE of a type's spans count, so that the labelers' size does not grow with the corpus.
    """
    total = {k: sum(c.values()) for k, c in counts.items()}
    prior = {k: sum(n * sure[k, v] for v, n in c.items()) / total[k] for k, c in counts.items()}
    schema = "kind string, votes array<int>, p double, least double"
    known = spans.sparkSession.createDataFrame([(k, list(v), p, max(5.0, LEAST_SHARE * total[k])) for (k, v), p in sure.items()], schema)
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("word")) for x in ("left", "right")])).alias("s")
    rows = spans.select("kind", "votes", sides).groupBy("kind", "votes", "s.side", "s.word").agg(F.count("*").alias("n")).join(F.broadcast(known), ["kind", "votes"])  # one row a vote pattern
    often = rows.groupBy("kind", "side", "word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p"), F.first("least").alias("least")).where((F.col("n") >= F.col("least")) & (F.col("word") != ""))
    out: dict = {}
    for r in often.collect():  # at most 1 / LEAST_SHARE words a type and side
        share = min(max(prior[r["kind"]], 0.01), 0.99)
        out.setdefault((r["kind"], r["side"]), {})[r["word"]] = float(np.log((r["p"] + share) / (r["n"] - r["p"] + 1 - share)) - np.log(share / (1 - share)))
    return out


def fit_spans(spans: DataFrame, max_sample: int = MAX_SAMPLE) -> Judge:
    """The judge of candidate spans, which are read several times and should be written down before.

    Vote patterns and context words are counted over all of them; the classifier sees at most about ``max_sample`` spans.
    """
    forms = _counts(spans)
    sure = reliabilities(forms)
    learned = Judge(context_words(spans, forms, sure) if forms else {}, np.zeros(BUCKETS))

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(votes=[list(learned.votes(k, v, x, y)) for k, v, x, y in zip(b["kind"], b["votes"], b["left"], b["right"], strict=True)])

    wide = spans.select("kind", "votes", "left", "right", "h").mapInPandas(widen, "kind string, votes array<int>, left string, right string, h bigint")
    counts = _counts(wide)
    target = reliabilities(counts)
    part = min(1.0, max_sample / max(1, sum(sum(c.values()) for c in counts.values())))
    rows = wide.where(F.col("h") < int(part * 2**32)).groupBy("kind", "votes", "left", "right").agg(F.count("*").alias("n")).collect()  # a bounded sample
    return Judge(learned.beside, fit_classifier([(r["kind"], r["votes"], r["left"], r["right"], r["n"]) for r in rows], target))


def fit(reviews: DataFrame, fields: Sequence[str], id_col: str = "id", max_sample: int = MAX_SAMPLE) -> Judge:
    """The judge of a corpus's spans."""
    return fit_spans(cut(candidate_spans(reviews, fields, id_col)), max_sample)


def decided_types(spans: DataFrame, judge: Judge, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, field_name, pii_type): the types that occur in each field among its candidate spans, once."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [judge.probability(k, v, x, y) >= threshold for k, v, x, y in zip(b["kind"], b["votes"], b["left"], b["right"], strict=True)]
            yield b.loc[kept, ["row_id", "field_name", "kind"]]

    return spans.mapInPandas(decide, "row_id string, field_name string, kind string").withColumnRenamed("kind", "pii_type").distinct()


def found_types(reviews: DataFrame, judge: Judge, fields: Sequence[str], id_col: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, field_name, pii_type): the types that occur in each field, once. Null and empty fields have none."""
    return decided_types(candidate_spans(reviews, fields, id_col), judge, threshold)


def learn_and_find(reviews: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """``found_types`` by the judge of the same reviews, whose texts are read once."""
    spans = cut(candidate_spans(reviews, fields, id_col))
    return decided_types(spans, fit_spans(spans))


def _decided(text: str, judge: Judge, threshold: float) -> list[Span]:
    return [s for s in candidates(text) if judge.probability(s.kind, s.votes, s.left, s.right) >= threshold]


def redacted(text: str | None, judge: Judge, threshold: float = THRESHOLD) -> str | None:
    """The text with typed placeholders in place of its private spans, else unchanged."""
    if not text:
        return text
    for s in sorted(_decided(text, judge, threshold), key=lambda s: -s.start):
        text = f"{text[: s.start]}[{s.kind.upper()}]{text[s.end :]}"
    return text


def redact(reviews: DataFrame, judge: Judge, fields: Sequence[str], id_col: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, the fields): each row once, with typed placeholders; null and empty fields stay as they are."""

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{f: [redacted(t, judge, threshold) if isinstance(t, str) else None for t in b[f]] for f in fields})

    rows = spread(reviews.select(F.col(id_col).cast("string").alias("row_id"), *fields))
    return rows.mapInPandas(replace, "row_id string, " + ", ".join(f"{f} string" for f in fields)).dropDuplicates(["row_id"])
