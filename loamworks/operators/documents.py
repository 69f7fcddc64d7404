"""Cleaning, sectioning and chunking of documents."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.lexicons import LINE_MARKS, LINE_STARTS, SECTION_HEADINGS, SECTION_NAMES
from loamworks.functions.text import hit_count

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def clean_lines(c: Column, least_letters: float = 0.2) -> Column:
    """A text without lines that are mostly other than letters, and without encoded blocks."""
    no_blocks = F.regexp_replace(c, r"(?ms)^begin \d{3} .+?^end\s*$", "")
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.greatest(F.length(F.regexp_replace(x, r"\s", "")), F.lit(1))
    return F.array_join(F.filter(F.split(no_blocks, r"\r?\n"), lambda x: (F.trim(x) == "") | (letters(x) >= least_letters)), "\n")


def primary_document(c: Column) -> Column:
    """What stands between the first <TEXT> and its end, or the whole text."""
    got = F.regexp_extract(c, r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1)
    return F.when(got != "", got).otherwise(c)


def visible_text(c: Column) -> Column:
    """The text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def within_budget(df: DataFrame, key: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The leading rows of each key whose texts (or numbers of characters, if ``text`` is a number) fit the budget together."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(text) if dict(df.dtypes)[text] == "string" else F.col(text)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def packed_sentences(text: str | None, most: int, overlap: int) -> list[str]:
    """Chunks of whole sentences of at most ``most`` words; a longer sentence is cut, and a chunk starts with the last words of the one before if they fit."""
    out: list[list[str]] = []
    room: list[str] = []
    for s in _SENTENCE.split((text or "").strip()):
        words = s.split()
        if len(words) > most:
            if room:
                out.append(room)
                room = []
            step = max(1, most - overlap)
            out += [words[i : i + most] for i in range(0, len(words), step)]
        elif len(room) + len(words) <= most:
            room = room + words
        else:
            out.append(room)
            room = words
    if room:
        out.append(room)
    lead = lambda i: out[i - 1][-overlap:] if overlap and i else []
    return [" ".join(lead(i) + w if len(lead(i)) + len(w) <= most else w) for i, w in enumerate(out)]


def chunked(df: DataFrame, most: int = 1000, overlap: int = 75) -> DataFrame:
    """(doc_id, chunk_index, content, word_count, start_char): the chunks of documents (doc_id, text); start_char is null where the chunk is not verbatim."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for i, c in enumerate(packed_sentences(text, most, overlap)):
                    at = text.find(c)
                    rows.append((doc, i, c, len(c.split()), at if at >= 0 else None))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "word_count", "start_char"]).astype({"start_char": "Int64"})

    return df.where("text is not null").select("doc_id", "text").mapInPandas(cut, "doc_id bigint, chunk_index int, content string, word_count int, start_char bigint")


def section_bounds(df: DataFrame, pattern: str, least_gap: int = 250) -> DataFrame:
    """(doc_id, section, start, end) of documents (doc_id, text): headings at least ``least_gap`` characters after the last one kept, each up to the next."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heading = re.compile(pattern, re.I | re.M)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                kept: list[tuple[int, str]] = []
                for m in heading.finditer(text):
                    if not kept or m.start() - kept[-1][0] >= least_gap:
                        kept.append((m.start(), " ".join(m.group().split())))
                ends = [s for s, _ in kept[1:]] + [len(text)]
                rows += [(doc, h, s, e) for (s, h), e in zip(kept, ends)] or [(doc, "Unknown", 0, len(text))]  # noqa: B905
            yield pd.DataFrame(rows, columns=["doc_id", "section", "start", "end"])

    return df.where("text is not null").select("doc_id", "text").mapInPandas(find, "doc_id bigint, section string, start bigint, end bigint")


def narrative_lines(c: Column) -> Column:
    """A filing's text without the lines that are no narrative: headers, markup, file lists, figures, encoded blocks and lines of signs.

    Encoded blocks go from their begin line to their end line, or to the end of the text without one. Lines are stripped;
    of empty lines in a row at most two stay. A null text stays null.
    """
    start = "(?i)^(?:" + "|".join(LINE_STARTS) + ")"
    text = F.regexp_replace(c, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?msi)^[ \t]*begin\s+\d{3}\s+[^\n]+\n.*?(?:^[ \t]*end[ \t]*(?:\n|\z)|\z)", "")
    count = lambda x, p: F.length(x) - F.length(F.regexp_replace(x, p, ""))

    def told(x: Column) -> Column:
        n, letters = F.length(x), count(x, r"\p{L}")
        figures = (n >= 10) & (letters < 0.20 * n) & ~x.rlike("^(http|www|//)")
        signs = (n >= 60) & (count(x, r"[^\p{L}\p{N}\s]") > 0.35 * n)
        brackets = (n >= 20) & (count(x, r"[()]") > 0.3 * n)
        encoded = (n >= 56) & x.rlike(r"^M[\x20-\x7E]{55,}$")
        low = F.lower(x)
        marked = (hit_count(low, LINE_MARKS) > 0) | F.contains(low, F.lit("taxonomy")) & low.rlike("taxonomy.*extension")
        return (x == "") | ~(x.rlike(start) | marked | figures | signs | brackets | encoded)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t"))), told)
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit("\n"))


def heading_spans(text: str, form: str, least_gap: int = 250, intro: int = 900) -> list[tuple[str, int, int]]:
    """(section, start, end) of a filing by the headings of its form; a heading less than ``least_gap`` after another is none.

    What stands before the first heading is the Intro if it is longer than ``intro``; a text without headings is Unknown.
    """
    found = []
    for h in SECTION_HEADINGS.get(form, ()):
        name = re.escape(h).replace(r"\?", "?").replace(r"\ ", r"\s+")
        pattern = rf"\n\s*{name}\s*[.:\-]\s+" if h.startswith("Item") else rf"\n\s*{name}\s*\n"
        found += [(m.start(), SECTION_NAMES.get(h, h)) for m in re.finditer(pattern, f"\n{text}\n", re.I)]
    cuts: list[tuple[int, str]] = []
    for at, name in sorted(found):
        if not cuts or at - cuts[-1][0] >= least_gap:
            cuts.append((at, name))
    if not cuts:
        return [("Unknown", 0, len(text))]
    ends = [at for at, _ in cuts[1:]] + [len(text)]
    spans = [("Intro", 0, cuts[0][0])] if cuts[0][0] > intro else []
    spans += [(name, max(at - 1, 0), end) for (at, name), end in zip(cuts, ends, strict=True)]
    return [x for x in spans if text[x[1] : x[2]].strip()] or [("Unknown", 0, len(text))]


def _size(text: str) -> int:
    return len(text.split())


def noise(block: str) -> bool:
    """Whether a paragraph is too short, a table of short lines, or almost without letters."""
    n, lines = _size(block), block.strip().splitlines()
    table = len(lines) >= 10 and sum(_size(x) <= 6 for x in lines) > 0.65 * len(lines)
    return n < 10 or table or n < 50 and sum(map(str.isalpha, block)) < 0.10 * len(block)


def blocks(text: str, least: int = 150) -> list[str]:
    """The paragraphs of a text; noise goes with the paragraph after it, or the last one, and short paragraphs in a row are one block while they stay below ``least`` words."""
    kept: list[str] = []
    held: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n+", text) if x.strip()):
        held.append(p)
        if not noise(p):
            kept.append("\n".join(held))
            held = []
    if held:
        kept[-1:] = ["\n".join(kept[-1:] + held)]
    out: list[list[str]] = [[]]
    for b in kept:
        if sum(map(_size, out[-1])) + _size(b) < least:
            out[-1].append(b)
        else:
            out += [[b], []]
    return ["\n\n".join(x) for x in out if x]


def section_chunks(text: str, least: int = 500, most: int = 1000, overlap: int = 75) -> list[str]:
    """Chunks of ``least`` to ``most`` words of a section: whole blocks, cut at sentences where one is too long.

    A chunk that is too short joins the next or else the one before if both fit; each chunk starts with the last
    ``overlap`` words of the one before if it has room for them.
    """
    units = [u for b in blocks(text) for u in (packed_sentences(b, most, 0) if _size(b) > most else [b])]
    chunks: list[list[str]] = [[]]
    for u in units:
        n, room = _size(u), most - sum(map(_size, chunks[-1]))
        if not chunks[-1] and least <= n <= most:
            chunks[-1:] = [[u], []]
        elif n <= room:
            chunks[-1].append(u)
        else:
            chunks.append([u])
    whole = ["\n\n".join(c) for c in chunks if c]
    merged: list[str] = []
    while whole:
        c = whole.pop(0)
        if _size(c) < least and len(merged) + len(whole) > 0:
            if whole and _size(c) + _size(whole[0]) <= most:
                c = f"{c}\n\n{whole.pop(0)}"
            elif merged and _size(merged[-1]) + _size(c) <= most:
                c = f"{merged.pop()}\n\n{c}"
        merged.append(c)
    tails = ["", *(" ".join(c.split()[-overlap:]) for c in merged)]
    return [f"{t} {c}" if t and _size(t) + _size(c) <= most else c for t, c in zip(tails, merged, strict=False)]


def filing_chunks(documents: DataFrame, least: int = 500, most: int = 1000, overlap: int = 75) -> DataFrame:
    """(doc_id, section, chunk_index, start, end, n_words): the chunks of each section of documents (doc_id, form, text).

    ``chunk_index`` counts from 0 over a document; ``start`` and ``end`` are where a chunk first stands in the text as it is, null
    where it does not, as after an overlap. Null and blank texts give no row.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, form, text in zip(b["doc_id"], b["form"], b["text"], strict=True):
                pieces = [(name, c) for name, s, e in heading_spans(text, form or "") for c in section_chunks(text[s:e], least, most, overlap)]
                for k, (name, c) in enumerate(pieces):
                    at = text.find(c)
                    rows.append((doc, name, k, None if at < 0 else at, None if at < 0 else at + len(c), _size(c)))
            out = pd.DataFrame(rows, columns=["doc_id", "section", "chunk_index", "start", "end", "n_words"])
            yield out.astype({"start": "Int64", "end": "Int64"})

    rows = documents.where("trim(text) <> ''").select("doc_id", "form", "text")
    return rows.mapInPandas(cut, "doc_id bigint, section string, chunk_index int, start bigint, end bigint, n_words int")
