"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the words of the normalised test items scans the words of each text once. Its patterns are
aligned blocks of half a passage: whoever holds a whole passage holds one of them, from which the match is extended word
by word. Offsets are mapped back to the original text.
"""

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.lineage import spread

WORD = re.compile(r"[^\W_]+")
#: Words in a row that make a leak; items per automaton, which bounds what is collected and broadcast at a time.
MIN_WORDS, MAX_ITEMS = 13, 50_000


def normal_words(text: str | None) -> list[str]:
    """The words of a text, runs of letters and digits, without regard to case and to how accents are encoded."""
    if not text:
        return []
    return " ".join(WORD.findall(unicodedata.normalize("NFC", text))).casefold().split()


def _joins(ch: str) -> bool:
    """Whether a character may compose with the one before it: an accent or vowel sign of its own, or a later part of a Hangul syllable."""
    return unicodedata.category(ch) in ("Mn", "Mc") or "\u1160" <= ch <= "\u11ff"


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in the text as it is of each of its ``normal_words``."""
    if unicodedata.is_normalized("NFC", text):
        return [m.span() for m in WORD.finditer(text)]
    starts = [i for i, ch in enumerate(text) if i == 0 or not _joins(ch)] + [len(text)]
    pieces = [unicodedata.normalize("NFC", text[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    places = [0]
    for x in pieces:
        places.append(places[-1] + len(x))
    at = lambda i: starts[bisect_right(places, i) - 1]
    return [(at(m.start()), starts[bisect_right(places, m.end() - 1)]) for m in WORD.finditer("".join(pieces))]


class _Numbers(dict):
    """Words numbered from 1; a word without a number is 0."""

    def __missing__(self, word: str) -> int:
        return 0


def _automaton(items: list[tuple[object, list[str]]], block: int):
    """The automaton over numbered words, and the numbers; None without a block."""
    import ahocorasick

    number = _Numbers()
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(items):
        own = [number.setdefault(w, len(number) + 1) for w in words]
        for i in range(0, len(own) - block + 1, block):
            places.setdefault(tuple(own[i : i + block]), []).append((k, i))
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p, at in places.items():
        auto.add_word(p, at)
    auto.make_automaton()
    return (auto, number) if places else (None, number)


def _runs(words: list[str], hits, items, min_words: int) -> Iterator[tuple[int, int, int]]:
    """(item index, first word, words) of each maximal common run that is long enough; hits come in the order of the text."""
    done: dict[tuple[int, int], int] = {}
    for w, k, i in hits:
        if w < done.get((k, w - i), -1):
            continue
        item = items[k][1]
        a, x = w, i
        while a and x and words[a - 1] == item[x - 1]:
            a, x = a - 1, x - 1
        b, y = w, i
        while b < len(words) and y < len(item) and words[b] == item[y]:
            b, y = b + 1, y + 1
        done[k, w - i] = b
        if b - a >= min_words:
            yield k, a, b - a


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, start, end, n_words): each passage of at least ``min_words`` words in a row of an item's text in a document.

    ``start`` and ``end`` are character offsets in the original text. Case, punctuation, markup signs, spacing and the
    encoding of accents do not matter. Null and empty texts, and items shorter than the passage, give no row. Items are
    taken in blocks of at most ``max_items``, each with one automaton over all documents, so that what a task holds is
    bounded; only sets of more items than that read the documents again.
    """
    spark = documents.sparkSession
    known = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    blocks = -(-max(1, known.count()) // max_items)
    block = (min_words + 1) // 2
    out = None
    for part in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], normal_words(r["text"])) for r in rows])

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            entries = shared.value
            auto, number = _automaton(entries, block)
            for b in batches:
                found = []
                for doc, text in zip(b["doc_id"], b["text"], strict=True):
                    words = normal_words(text)
                    if auto is None or len(words) < min_words:
                        continue
                    hits = [(e + 1 - block, k, i) for e, at in auto.iter(tuple(map(number.__getitem__, words))) for k, i in at]
                    spans = None
                    for k, a, n in _runs(words, hits, entries, min_words):
                        spans = spans or word_spans(text)
                        found.append((doc, entries[k][0], spans[a][0], spans[a + n - 1][1], n))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "n_words"])

        part_out = spread(documents.where("text is not null").select("doc_id", "text")).mapInPandas(scan, "doc_id bigint, item_id bigint, start bigint, end bigint, n_words bigint")
        out = part_out if out is None else out.unionByName(part_out)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id): every pair of a document and an item that leaked into it, once."""
    return leaked_spans(documents, items, min_words, max_items).select("doc_id", "item_id").distinct()
