"""Missing or wrong document language labels.

Word-first backoff: a known word scores by its log frequency in each language; an unseen word falls back to the longest
known character n-gram at each place, then to shorter ones. The frequencies come from a bounded sample of labelled
documents and are refined by relabelling the sample's sentences, so that wrong labels and mixed texts wash out.
"""

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.lineage import spread

# Other spellings of language codes.
SPELLINGS = {
    "en": ("eng", "english", "englisch", "anglais", "ingles", "inglés"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "spanisch"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch"),
    "nl": ("nld", "dut", "dutch", "nederlands", "niederländisch", "flemish"),
}
NO_LANGUAGE = ("und", "unknown", "unk", "xx", "xxx", "mul", "mis", "zxx", "none", "null", "n/a", "na", "other", "?", "-")



def _letters() -> str:
    """A character class of all letters of the basic plane, as ranges, which matches faster than negated classes."""
    flags = np.array([chr(i).isalpha() for i in range(0x10000)] + [False])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags)).astype(np.int8)))
    return "[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]"


WORD = re.compile(_letters() + "+")
#: A break between sentences starts with a mark that ends one, a colon or a line end; where a group matched, that is the break.
_BREAK = re.compile(r"[.!?…:\n](?:(?<=[.!?…])[\"')\]»”]?(\s+)|(?<=:)(\n\s*)|(?<=\n)(?:\s*\n\s*|\s*(?=[-*•])))")

#: A code is a language of the corpus if it makes up so much of the labels; rarer ones are taken for faults.
LEAST_SHARE = 0.005
#: Labelled documents that the model is fitted on, at most; rounds of relabelling; least count of a known word and of one that gives n-grams; longest n-gram.
MAX_SAMPLE, ROUNDS, MIN_COUNT, GRAM_COUNT, LONGEST = 20_000, 2, 3, 2, 5
#: A sentence has so many words; a further language needs a sentence of so many, ahead of the main one by so many nats.
MIN_WORDS, OTHER_WORDS, OTHER_MARGIN, OTHER_WORD_MARGIN = 3, 4, 6.0, 0.6


def label_code(c: str):
    """The two-letter code of a language label, null where it names no language."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"^[\s\"']+|[\s\"'.]+$", ""))
    head = F.element_at(F.split(bare, r"[-_ ]"), 1)
    code = F.when(bare.isNull() | (bare == "") | bare.isin(*NO_LANGUAGE), F.lit(None))
    for lang, names in SPELLINGS.items():
        code = code.when(bare.isin(*names) | head.isin(lang, *names), F.lit(lang))
    return code.otherwise(head)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of the sentences of a text; spans without enough words are none."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start(m.lastindex or 0) if m else len(text)
        words = WORD.findall(text[at:end].lower())
        if len(words) >= MIN_WORDS:
            out.append((at, end, words))
        at = m.end() if m else end
    return out


class Model:
    """Log frequencies of words and n-grams by language, each less its mean over languages; ``parts`` is what is broadcast."""

    def __init__(self, languages: Sequence[str], words: dict[str, int], word_scores: np.ndarray, grams: dict[str, int], gram_scores: np.ndarray):
        self.parts = (tuple(languages), words, word_scores, grams, gram_scores)
        self.languages, self.words, self.word_scores, self.grams, self.gram_scores = self.parts

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray], languages: Sequence[str], backoff: bool = True, total: np.ndarray | None = None) -> "Model":
        """The model of counts of each word by language; ``total`` counts all words, the rare ones that were left out too. Without ``backoff`` unseen words say nothing."""
        names, width = list(counts), len(languages)
        table = np.array([counts[w] for w in names]).reshape(-1, width)
        total = (table.sum(0) if total is None else total) + 1.0
        kept = np.flatnonzero(table.sum(1) >= MIN_COUNT)
        scores = np.log((table[kept] + 0.3) / (total + 0.3 * len(kept)))
        words = {names[i]: k for k, i in enumerate(kept)}
        grams: dict[str, int] = {}
        gram_scores = np.zeros((0, width))
        if backoff:
            at, of = [], []
            for i in np.flatnonzero(table.sum(1) >= GRAM_COUNT):
                w = names[i]
                padded = f"_{w}_"
                for n in range(1, LONGEST + 1):
                    for k in range(len(padded) - n + 1):
                        at.append(grams.setdefault(padded[k : k + n], len(grams)))
                        of.append(i)
            share = np.sqrt(table / total * 1e6)
            mass = np.stack([np.bincount(at, share[of, j], len(grams)) for j in range(width)], axis=1) if at else gram_scores
            length = np.fromiter((len(g) for g in grams), int, len(grams))
            by_length = np.stack([np.bincount(length, mass[:, j], LONGEST + 1) for j in range(width)], axis=1) + 1.0 if at else None
            often = np.flatnonzero(mass.max(1) > 2.0) if at else np.zeros(0, int)
            gram_scores = np.log((mass[often] + 0.5) / by_length[length[often]]) if at else gram_scores
            spelt = list(grams)
            grams = {spelt[i]: k for k, i in enumerate(often)}
        centred = [x - x.mean(1, keepdims=True) if len(x) else x for x in (scores, gram_scores)]
        return cls(languages, words, centred[0], grams, centred[1])

    def _coded(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The letters of the n-grams, and of each length the sorted codes of the n-grams and their rows."""
        if not hasattr(self, "_codes"):
            letters = np.array(sorted({ord(ch) for g in self.grams for ch in g} or {0}), np.uint32)
            bits = np.uint64(max(1, int(len(letters)).bit_length()))
            place = {int(x): k + 1 for k, x in enumerate(letters)}
            by: list[dict[int, int]] = [{} for _ in range(LONGEST + 1)]
            for g, row in self.grams.items():
                code = 0
                for ch in g:
                    code = code << int(bits) | place[ord(ch)]
                by[len(g)][code] = row
            tables = []
            for t in by:
                order = sorted(t)
                tables.append((np.array(order, np.uint64), np.array([t[c] for c in order], np.int64)))
            self._codes = letters, bits, tables
        return self._codes

    def unseen(self, words: Sequence[str]) -> np.ndarray:
        """Backoff scores of words: half the mean, over a word's places, of the longest known n-gram there; 0 where none is known."""
        width = len(self.languages)
        if not len(words) or not self.grams:
            return np.zeros((len(words), width))
        letters, bits, tables = self._coded()
        longest = min(LONGEST, 63 // int(bits))
        text = np.frombuffer("".join([f"_{w}_" for w in words]).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.repeat(np.cumsum(sizes), sizes)
        at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        code = np.where(letters[at] == text, at + 1, 0).astype(np.uint64)
        known = code > 0
        grams, fits = [code], [known]
        for n in range(2, longest + 1):
            grams.append(np.zeros_like(code))
            fits.append(np.zeros_like(known))
            if n <= len(code):
                grams[-1][: -(n - 1)] = grams[-2][: -(n - 1)] << bits | code[n - 1 :]
                fits[-1][: -(n - 1)] = fits[-2][: -(n - 1)] & known[n - 1 :]
        places = np.arange(len(code))
        row = np.full(len(code), -1)
        inner = places < ends - 1
        for n in range(longest, 0, -1):
            codes, rows = tables[n]
            ask = np.flatnonzero((row < 0) & inner & fits[n - 1] & (places + n <= ends))
            if len(codes) and len(ask):
                k = np.minimum(np.searchsorted(codes, grams[n - 1][ask]), len(codes) - 1)
                row[ask] = np.where(codes[k] == grams[n - 1][ask], rows[k], -1)
        hit = row >= 0
        padded = np.concatenate([self.gram_scores, np.zeros((1, width))])[row]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        number = np.add.reduceat(hit.astype(np.int64), first)
        return 0.5 * np.add.reduceat(padded, first) / np.maximum(number, 1)[:, None]

    def scores(self, sentences_words: list[list[str]]) -> np.ndarray:
        """Log likelihood of each sentence by language, up to a constant; no sentence may be empty."""
        known, extra, rows = self.words, {}, []
        for words in sentences_words:
            for w in words:
                k = known.get(w)
                if k is None:
                    k = extra.setdefault(w, len(self.word_scores) + len(extra))
                rows.append(k)
        table = np.concatenate([self.word_scores, self.unseen(list(extra))]) if extra else self.word_scores
        first = np.cumsum([0] + [len(w) for w in sentences_words[:-1]])
        return np.add.reduceat(table[rows], first)


def _assigned(texts: Sequence[str], model: Model) -> tuple[list[list[tuple]], np.ndarray, np.ndarray]:
    """The sentences of each text; of all sentences in a row, the language index and the scores.

    A text holds its main language, and others in which a sentence is clearly ahead of all the rest; its sentences are
    in the main language but for those clearly ahead of it.
    """
    split = [sentences(t) for t in texts]
    flat = [w for parts in split for *_, w in parts]
    if not flat:
        return split, np.zeros(0, int), np.zeros((0, len(model.languages)))
    scored = model.scores(flat)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    held = np.flatnonzero(sizes)
    first = np.cumsum(sizes) - sizes
    main = np.zeros(len(split), np.int64)
    main[held] = np.add.reduceat(scored, first[held]).argmax(1)
    doc = np.repeat(np.arange(len(split)), sizes)
    best, top = scored.argmax(1), scored.max(1)
    second = np.partition(scored, -2, axis=1)[:, -2] if scored.shape[1] > 1 else np.full(len(scored), -np.inf)
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    lead = top - scored[np.arange(len(scored)), main[doc]]
    sure = (length >= OTHER_WORDS) & (lead >= OTHER_MARGIN) & (lead / length >= OTHER_WORD_MARGIN)
    clear = sure & (top - second >= OTHER_MARGIN)
    langs = main[doc]
    for d in np.unique(doc[sure]):
        own = np.arange(first[d], first[d] + sizes[d])
        choice = np.array(sorted({int(main[d]), *best[own[clear[own]]].tolist()}))
        moved = own[sure[own]]
        langs[moved] = choice[scored[np.ix_(moved, choice)].argmax(1)]
    return split, langs, scored


def _passages(texts: Sequence[str], model: Model) -> Iterator[tuple[int, int, int, int, float]]:
    """(text index, lang index, start, end, confidence) of the passages of the texts, in order."""
    split, langs, scored = _assigned(texts, model)
    if not len(langs):
        return
    doc = np.repeat(np.arange(len(split)), [len(p) for p in split])
    spots = [(a, b) for parts in split for a, b, _ in parts]
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (langs[1:] != langs[:-1]))))
    ends = np.append(starts[1:], len(doc)) - 1
    total = np.add.reduceat(scored, starts)
    own = total[np.arange(len(starts)), langs[starts]]
    sure = 1 / np.exp(np.minimum(total - own[:, None], 700)).sum(1)
    for s, e, c in zip(starts.tolist(), ends.tolist(), sure.tolist(), strict=True):
        yield int(doc[s]), int(langs[s]), spots[s][0], spots[e][1], c


def languages_of(documents: DataFrame, least_share: float = LEAST_SHARE) -> dict[str, int]:
    """The languages that the labels of a corpus name often enough, with their number of labels."""
    codes = documents.select(label_code("lang").alias("code")).where(F.col("code").rlike("^[a-z]{2}$")).groupBy("code").agg(F.count("*").alias("n"))
    often = codes.join(F.broadcast(codes.agg(F.sum("n").alias("all"))), F.col("n") >= least_share * F.col("all"))
    return {r["code"]: r["n"] for r in often.orderBy("code").collect()}  # at most one row for each least share


def _counted(rows: DataFrame, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts by language of the words that stand often enough to be of use, and of all words (the word "")."""
    sums = rows.groupBy("word").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(width)])
    kept = sums.where(sum(F.col(f"n{j}") for j in range(width)) >= min(MIN_COUNT, GRAM_COUNT))
    out = {r["word"]: np.array(r[1:], float) for r in kept.toLocalIterator()}  # words of a bounded sample
    return out, out.pop("", np.zeros(width))


def fit(documents: DataFrame, languages: Sequence[str] | None = None, max_sample: int = MAX_SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of the labelled documents, of which at most about ``max_sample`` are taken by a hash of their ids.

    The languages are those of the labels, ``languages_of``, where none are given.
    """
    known = languages_of(documents)
    codes = tuple(languages or known)
    width = len(codes)
    if not width:
        return Model((), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = min(1.0, max_sample / max(1, sum(known.get(c, 0) for c in codes)))
    labelled = documents.where("text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = spread(labelled.select("text", label_code("lang").alias("lang")).where(F.col("lang").isin(*codes))).persist()

    def count(batches: Iterator[pd.DataFrame], shared=None) -> Iterator[pd.DataFrame]:
        model = None if shared is None else Model(*shared.value)
        for b in batches:
            c: list[Counter] = [Counter() for _ in codes]
            if model is not None:
                split, langs, _ = _assigned(list(b["text"]), model)
                for k, words in zip(langs.tolist(), (w for parts in split for *_, w in parts), strict=True):
                    c[k].update(words)
            for text, lang in zip(b["text"], b["lang"], strict=True) if model is None else ():
                for *_, words in sentences(text):
                    c[codes.index(lang)].update(words)
            words = {w: k for k, w in enumerate({w for x in c for w in x})}
            table = np.zeros((len(words) + 1, width), np.int64)
            for j, x in enumerate(c):
                table[[words[w] for w in x], j] = list(x.values())
            table[-1] = table.sum(0)
            yield pd.DataFrame(table, columns=[f"n{j}" for j in range(width)]).assign(word=[*words, ""])

    schema = ", ".join(f"n{j} bigint" for j in range(width)) + ", word string"
    model = Model.of_counts({}, codes)
    try:
        for r in range(rounds + 1):
            shared = documents.sparkSession.sparkContext.broadcast(model.parts) if r else None
            counts, total = _counted(sample.mapInPandas(lambda it, shared=shared: count(it, shared), schema), width)
            model = Model.of_counts(counts, codes, backoff=r == rounds, total=total)
    finally:
        sample.unpersist()
    return model


def language_passages(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, start, end, confidence, label): the passages of each document, each in one language, with character offsets.

    ``label`` is the code of the stored label. Null and empty texts, and texts without a sentence, give no row;
    nor does a corpus without a labelled language.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.parts)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for b in batches:
            docs, labels = b["doc_id"].tolist(), b["label"].tolist()
            rows = [(docs[i], m.languages[k], a, e, c, labels[i]) for i, k, a, e, c in (_passages(b["text"].tolist(), m) if m.languages else ())]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "start", "end", "confidence", "label"])

    rows = spread(documents.where("text is not null").select("doc_id", "text", label_code("lang").alias("label")))
    return rows.mapInPandas(assign, "doc_id bigint, lang string, start bigint, end bigint, confidence double, label string")


def label_faults(passages: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing or wrong, or that holds several languages."""
    each = passages.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    fault = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return each.where(fault).select("doc_id", F.explode("langs").alias("lang"))
