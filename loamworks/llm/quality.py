"""Per-document text quality statistics.

A text is cut into pieces of bounded length; each piece gives counts of its whole lines, which add up, and the state of the
lines it cuts: their counts, and the words left open at both ends. Merging the pieces of a text closes these words and
lines, so that a text counts alike wherever it is cut. Ratios and rules follow.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.lineage import spread

# Common English function words.
COMMON_WORDS = frozenset(
    "the a an of and or to in on at by for with from as is are was were be been being it its this that these those not no nor but if so than then "
    "which who whom whose what when where while because although though after before during under over into through between against without within "
    "about per our we us you your he she they them his her their has have had having do does did will would may might can could should must also any "
    "all each every some such other more most only own same both few how there here my me".split()
)
_EDGE = ".,;:!?()[]{}\"'*“”‘’…-–—_>#"
#: Characters of a piece; a line is prose from PROSE_SHARE of function words on, and where NEAR_SHARE of them stand beside prose.
PIECE, PROSE_SHARE, NEAR_SHARE, MIN_LETTERS, MIN_WORD = 1 << 20, 0.12, 0.03, 0.55, 2.5

COUNTS = ["n_chars", "n_marks", "n_words", "n_word_chars", "n_common", "n_lines", "n_punct_lines", "n_prose", "n_other"]


def word_counts(words: list[str]) -> list[int]:
    """Of some words: their number, plain words, letters in plain words, common words, characters. A plain word is letters between edge punctuation."""
    plain = letters = common = 0
    for t in words:
        core = t.lower().strip(_EDGE)
        if core.isalpha() or (len(core) > 2 and core.replace("-", "").replace("'", "").replace("’", "").isalpha()):
            plain += 1
            letters += len(core)
            common += core in COMMON_WORDS
    return [len(words), plain, letters, common, sum(map(len, words))]


def open_line(text: str) -> list:
    """The state of part of a line: [word] without white space, else [open first word, counts, last closed character, open last word]."""
    words = text.split()
    if not words:
        return ["", [0, 0, 0, 0, 0], "", ""] if text else [""]
    if len(words) == 1 and words[0] == text:
        return [text]
    first = "" if text[0].isspace() else words.pop(0)
    last = "" if text[-1].isspace() or not words else words.pop()
    return [first, word_counts(words), words[-1][-1] if words else "", last]


def followed(a: list, b: list) -> list:
    """The state of two parts of a line, one after the other. Associative; [""] is neutral."""
    if len(a) == 1:
        return [a[0] + b[0], *b[1:]]
    if len(b) == 1:
        return [*a[:3], a[3] + b[0]]
    joint = [w] if (w := a[3] + b[0]) else []
    counts = [x + y + z for x, y, z in zip(a[1], word_counts(joint), b[1], strict=True)]
    return [a[0], counts, b[2] or w[-1:] or a[2], b[3]]


def closed(state: list) -> tuple[list[int], str]:
    """The counts of a whole line and its last character that is no white space."""
    if len(state) == 1:
        return word_counts([state[0]] if state[0] else []), state[0][-1:]
    ends = word_counts([w for w in (state[0], state[3]) if w])
    return [x + y for x, y in zip(state[1], ends, strict=True)], (state[3] or state[2] or state[0])[-1:]


def _kind(words: int, plain: int, letters: int, common: int, solid: int) -> str:
    """Whether a line is sentences, "y" or "n"; "?" where the lines beside it decide."""
    if not plain or letters / solid < MIN_LETTERS or letters / plain < MIN_WORD:
        return "n"
    share = common / words
    return "y" if share >= PROSE_SHARE else "?" if share >= NEAR_SHARE else "n"


class Lines:
    """Counts of whole lines and, of each that is not blank, its number, kind and characters."""

    def __init__(self):
        self.words = self.common = self.solid = self.punct = 0
        self.numbers: list[int] = []
        self.kinds: list[str] = []
        self.solids: list[int] = []

    def add(self, number: int, counts: list[int], last: str) -> None:
        words, _, _, common, solid = counts
        if words:
            self.words += words
            self.common += common
            self.solid += solid
            self.punct += last in ".!?;:"
            self.numbers.append(number)
            self.kinds.append(_kind(*counts))
            self.solids.append(solid)


PIECE_STATE = "at int, n_chars bigint, n_alnum bigint, breaks int, words bigint, common bigint, solid bigint, punct bigint, numbers array<int>, kinds string, solids array<int>, head string, tail string"


def piece_state(at: int, text: str, whole: bool) -> tuple:
    """The counts of a piece of a text (or of a ``whole`` text) and, of the lines it cuts, their states; its first line is number 1."""
    lines, head, tail = Lines(), None, None
    parts = text.split("\n")
    if not whole:
        head, tail = json.dumps(open_line(parts[0])), json.dumps(open_line(parts[-1])) if len(parts) > 1 else None
    for n, line in enumerate(parts, 1) if whole else enumerate(parts[1:-1], 2):
        if words := line.split():
            lines.add(n, word_counts(words), words[-1][-1])
    return (at, len(text), sum(map(str.isalnum, text)), len(parts) - 1, lines.words, lines.common, lines.solid, lines.punct, lines.numbers, "".join(lines.kinds), lines.solids, head, tail)


def merged(pieces: list, aside: frozenset) -> list[int]:
    """The COUNTS of a text from the states of its pieces, the lines of ``aside`` not judged as prose or other."""
    pieces = sorted({p["at"]: p for p in pieces}.values(), key=lambda p: p["at"])
    lines, before, state = Lines(), 0, [""]
    for p in pieces:
        if p["head"] is not None:
            state = followed(state, json.loads(p["head"]))
            if p["tail"] is not None:
                lines.add(before + 1, *closed(state))
                state = json.loads(p["tail"])
        lines.words, lines.common, lines.solid, lines.punct = lines.words + p["words"], lines.common + p["common"], lines.solid + p["solid"], lines.punct + p["punct"]
        lines.numbers += [before + int(n) for n in p["numbers"]]
        lines.kinds += p["kinds"]
        lines.solids += [int(x) for x in p["solids"]]
        before += p["breaks"]
    lines.add(before + 1, *closed(state))
    judged = [(k, s) for n, k, s in zip(lines.numbers, lines.kinds, lines.solids, strict=True) if n not in aside]
    prose = other = 0
    for i, (k, s) in enumerate(judged):
        near = k == "?" and (i > 0 and judged[i - 1][0] == "y" or i + 1 < len(judged) and judged[i + 1][0] == "y")
        prose, other = (prose + s, other) if k == "y" or near else (prose, other + s)
    marks = lines.solid - sum(p["n_alnum"] for p in pieces)
    return [sum(p["n_chars"] for p in pieces), marks, lines.words, lines.solid, lines.common, len(lines.numbers), lines.punct, prose, other]


def text_statistics(chunks: DataFrame, furniture: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """One row per chunk: counts, ratios, the stored word_count and the share of prose, with ``furniture`` lines (chunk_id, line_no) set aside.

    Null and empty contents have counts of 0 and null ratios; a chunk that stands twice comes out once. A text longer
    than ``piece`` is counted in pieces, with the same result. Texts are read where they lie; only counts are shuffled.
    """
    text = F.coalesce("content", F.lit(""))
    parts = F.when(F.length(text) <= piece, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    rows = spread(chunks.select("id", "content", "word_count")).select(F.col("id").cast("string").alias("chunk_id"), F.col("word_count").cast("bigint").alias("stored"), parts.alias("parts"))
    pieces = rows.select("chunk_id", "stored", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "text"))
    fields = [f.split()[0] for f in PIECE_STATE.split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([piece_state(a, t, n == 1) for a, t, n in zip(b["at"], b["text"], b["n"], strict=True)], columns=fields)
            yield pd.concat([b[["chunk_id", "stored"]].reset_index(drop=True), out], axis=1)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = frozenset()
        for b in batches:
            got = [merged(list(p), nothing if a is None or not len(a) else frozenset(a)) for p, a in zip(b["pieces"], b["aside"], strict=True)]
            yield pd.concat([b[["chunk_id", "stored"]].reset_index(drop=True), pd.DataFrame(got, columns=COUNTS)], axis=1)

    counted = pieces.mapInPandas(count, "chunk_id string, stored bigint, " + PIECE_STATE)
    held = counted.groupBy("chunk_id").agg(F.max("stored").alias("stored"), F.collect_set(F.struct(*fields)).alias("pieces"))
    if furniture is None:
        held = held.withColumn("aside", F.array().cast("array<bigint>"))
    else:
        aside = furniture.groupBy("chunk_id").agg(F.collect_set("line_no").alias("aside")).withColumnRenamed("chunk_id", "of")
        held = held.join(aside, F.col("chunk_id").eqNullSafe(F.col("of")), "left").drop("of")
    total = held.mapInPandas(finish, "chunk_id string, stored bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return total.select(
        "chunk_id", F.col("stored").alias("stored_word_count"), "n_chars", "n_words", "n_lines", ratio("n_word_chars", "n_words").alias("mean_word_length"), ratio("n_marks", "n_word_chars").alias("symbol_ratio"),
        ratio("n_punct_lines", "n_lines").alias("punctuated_line_share"), ratio("n_common", "n_words").alias("common_word_share"), F.try_divide("n_prose", F.col("n_prose") + F.col("n_other")).alias("prose_share"),
    )


def findings(stats: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(chunk_id, finding): ``not_prose`` where less than half of the text is sentences, ``word_count`` where the stored count is off by more than ``tolerance``."""
    wrong = F.abs(F.col("stored_word_count") - F.col("n_words")) > tolerance * F.col("n_words")
    found = F.array_compact(F.array(F.when(F.col("prose_share") < 0.5, "not_prose"), F.when(wrong, "word_count")))
    return stats.select("chunk_id", F.explode(found).alias("finding"))
