import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.llm import language as la
from loamworks.llm import leaks as le

DOCS = "doc_id bigint, text string, lang string, item_id bigint, label string"
ITEMS = "item_id bigint, suite string, text string, doc_id bigint"


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, None, 0, None) for i, t in docs], DOCS)
    return {tuple(r) for r in le.leaked_items(d, spark.createDataFrame([(i, None, t, 0) for i, t in items], ITEMS), **how).collect()}


def brute(docs, items, n=13):
    out = set()
    for d, t in docs:
        w = [x.casefold() for x in le.WORD.findall(t or "")]
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, s in items:
            v = [x.casefold() for x in le.WORD.findall(s or "")]
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(30)]
    items += [(30, items[0][1]), (31, " ".join(items[1][1].split()[:20]))]
    docs = []
    for d in range(120):
        own = rng.choices(words, k=rng.randint(0, 50))
        src = rng.choice(items)[1].split()
        n = rng.randint(8, 20)
        at = rng.randint(0, max(0, len(src) - n))
        part = [x.upper() if rng.random() < 0.3 else f"**{x}**," if rng.random() < 0.3 else x for x in src[at : at + n]]
        docs.append((d, " ".join(own[:20]) + " \n> " + "  ".join(part) + " " + " ".join(own[20:])))
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, max_items=7) == want
    assert found(spark, docs, items, min_words=6) == brute(docs, items, 6)


def test_accents_however_they_are_encoded(spark):
    item = "Où naît l’été, l’âme du café rêve à côté des forêts où naît encore l’hiver"
    loose = unicodedata.normalize("NFD", item)
    docs = [(1, "avant: " + loose + " après"), (2, item.upper()), (3, "한국어 " + loose.replace("\u0301", ""))]
    assert found(spark, docs, [(7, item)]) == {(1, 7), (2, 7)} == found(spark, docs, [(7, loose)])
    for text in (loose, unicodedata.normalize("NFD", "한국어 문장 " + item), item, "", "\u0301a \u0301"):
        spans = le.word_spans(text)
        assert [unicodedata.normalize("NFC", text[a:b]).casefold() for a, b in spans] == le.normal_words(text)


def test_one_word_over_and_over_takes_no_quadratic_time(spark):
    item = " ".join(["echo"] * 40)
    assert found(spark, [(1, "echo " * 60_000), (2, "echo " * 12)], [(1, item), (2, "echo " * 13)]) == {(1, 1), (1, 2)}


def test_nulls_empty_and_long(spark):
    item = " ".join(f"a{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "x " * 500_000 + item), (4, item), (4, item), (None, item)]
    assert found(spark, docs, [(1, item), (2, None), (3, "short one"), (1, item)]) == {(3, 1), (4, 1), (None, 1)}
    assert found(spark, [], [(1, item)]) == set() and found(spark, docs, []) == set()


def test_spans_point_into_the_original(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve THIRTEEN fourteen"
    text = "Ünd dann: " + item.replace(",", " --").upper() + "! end"
    d = spark.createDataFrame([(1, text, None, 0, None)], DOCS)
    r = le.leaked_spans(d, spark.createDataFrame([(7, None, item, 0)], ITEMS)).first()
    assert r["n_words"] == 14 and text[r["start"] : r["end"]].startswith("ONE TWO") and text[r["start"] : r["end"]].endswith("FOURTEEN")


TEXTS = {
    "en": ["The board has reviewed the plan for the year.", "We are pleased with the result of the work.", "There is no doubt that it was a good year for all of us."],
    "de": ["Der Vorstand hat den Plan für das Jahr geprüft.", "Wir sind mit dem Ergebnis der Arbeit zufrieden.", "Es gibt keinen Zweifel, dass es ein gutes Jahr für uns war."],
    "fr": ["Le conseil a examiné le plan pour cette année.", "Nous sommes contents du résultat de ce travail.", "Il n'y a pas de doute que ce fut une bonne année pour nous."],
    "es": ["El consejo ha revisado el plan para este año.", "Estamos contentos con el resultado de este trabajo.", "No hay duda de que fue un buen año para todos nosotros."],
    "pt": ["O conselho analisou o plano para este ano.", "Estamos contentes com o resultado deste trabalho.", "Não há dúvida de que foi um bom ano para todos nós."],
    "nl": ["Het bestuur heeft het plan voor dit jaar beoordeeld.", "Wij zijn tevreden met het resultaat van het werk.", "Er is geen twijfel dat het een goed jaar voor ons was."],
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for lang, parts in TEXTS.items():
        for _ in range(40):
            i += 1
            rows.append((i, " ".join(rng.choices(parts, k=4)), lang if rng.random() > 0.1 else rng.choice(list(TEXTS)), 0, None))
    return la.fit(spark.createDataFrame(rows, DOCS))


def faults(spark, model, rows):
    d = spark.createDataFrame([(i, t, g, 0, None) for i, t, g in rows], DOCS)
    return {tuple(r) for r in la.label_faults(la.language_passages(d, model)).collect()}


def test_faults(spark, model):
    en, de = TEXTS["en"], TEXTS["de"]
    rows = [
        (1, en[0], "en"), (2, en[0], "EN-us "), (3, en[1], "English"), (4, en[2], "de"), (5, en[2], None), (6, en[2], " "), (7, en[2], "und"),
        (8, " ".join(en + de), "en"), (9, de[0] + " (Machine Learning)", "Deutsch"), (10, "12 34 5.6", None), (11, None, None), (12, "", "xx"), (13, de[2].upper(), "nl"), (4, en[2], "de"),
    ]
    assert faults(spark, model, rows) == {(4, "en"), (5, "en"), (6, "en"), (7, "en"), (8, "en"), (8, "de"), (13, "de")}
    assert faults(spark, model, []) == set()


def test_held_out_accuracy_and_unseen_words(spark, model):
    new = {"en": "Our results were better than those of the others.", "de": "Unsere Ergebnisse waren besser als die der anderen.", "fr": "Nos résultats ont été meilleurs que ceux des autres.", "es": "Nuestros resultados fueron mejores que los de otros.", "pt": "Os nossos resultados foram melhores do que os dos outros.", "nl": "Onze resultaten waren beter dan die van de anderen."}
    got = {lang: model.languages[int(np.argmax(model.scores([s[0][2]])[0]))] for lang, t in new.items() if (s := la.sentences(t))}
    assert sum(a == b for a, b in got.items()) >= 5
    assert model.languages[int(np.argmax(model.unseen(["überprüfungen"])))] == "de"


def test_passages_cover_whole_texts(spark, model):
    text = " ".join(TEXTS["fr"]) + "\n\n" + " ".join(TEXTS["en"] * 2000)
    d = spark.createDataFrame([(1, text, None, 0, None)], DOCS)
    got = la.language_passages(d, model).orderBy("start").collect()
    assert [r["lang"] for r in got] == ["fr", "en"] and got[-1]["end"] == len(text) and all(0 < r["confidence"] <= 1 for r in got)


def test_label_codes(spark):
    rows = spark.createDataFrame([("pt_BR",), ("français",), ("it",), ("xx",), (None,), ("'de'",)], "x string").select(la.label_code("x").alias("x"))
    assert [r["x"] for r in rows.collect()] == ["pt", "fr", "it", None, None, "de"]
    assert rows.where(F.col("x").isNull()).count() == 2


def test_backoff_agrees_with_one_by_one():
    grams = {g: k for k, g in enumerate(["_a", "ab", "b_", "abc", "c", "_abcd", "é", "éab"])}
    model = la.Model(("x", "y"), {}, np.zeros((0, 2)), grams, np.arange(16.0).reshape(8, 2))

    def slow(word):
        padded, got = f"_{word}_", []
        for i in range(len(padded) - 1):
            fits = [padded[i : i + n] for n in range(la.LONGEST, 0, -1) if len(padded[i : i + n]) == n and padded[i : i + n] in grams]
            got += [model.gram_scores[grams[fits[0]]]] if fits else []
        return np.mean(got, axis=0) * 0.5 if got else np.zeros(2)

    words = ["abcd", "abc", "é", "zzz", "éabé", "c" * 5000, "abzab", "_"]
    assert np.allclose(model.unseen(words), [slow(w) for w in words]) and model.unseen([]).shape == (0, 2)


def test_languages_are_those_that_the_labels_name_often(spark):
    labels = ["it"] * 90 + ["en-US"] * 60 + ["sv"] * 50 + ["xx"] * 30 + [None] * 20 + ["tlh"] * 9
    docs = spark.createDataFrame([(i, "t", x, 0, None) for i, x in enumerate(labels)] + [(999, "t", "fi", 0, None)], DOCS)
    assert la.languages_of(docs, 0.01) == {"en": 60, "it": 90, "sv": 50}
    assert la.languages_of(docs.where("false")) == {} and la.language_passages(docs, la.fit(docs.where("false"))).count() == 0
