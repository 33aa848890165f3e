"""Language identification against plain versions of its parts, and what the pipeline's stage rejects."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from proselens.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TONGUES = {"en": "the and with that this from were which there their would about these other", "de": "der und nicht eine werden durch schön größer über zwischen straße können", "fr": "les une dans être été où après même très déjà voilà garçon élève"}
MASK = (1 << 64) - 1


def tongue(rnd, lang, n):
    return " ".join(rnd.choice(TONGUES[lang].split()) for _ in range(n))


def feature(gram):
    """The bucket of one n-gram, one operation at a time."""
    value = 0x9E3779B97F4A7C15 * ord(gram[0]) & MASK
    for c in gram[1:]:
        value = (value * 0xD1342543DE82EF95 + ord(c)) & MASK
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & MASK
    return (value ^ (value >> 31)) >> 49


def plain_counts(text):
    kept = " " + "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()) + " "
    grams = [c for c in kept if c != " "]
    grams += [kept[i : i + 2] for i in range(len(kept) - 1) if kept[i : i + 2] != "  "]
    grams += [kept[i : i + 3] for i in range(len(kept) - 2) if kept[i + 1] != " "]
    return Counter(feature(g) for g in grams)


@pytest.mark.parametrize("text", ["", "a", "Hello, World 42!", "ÉTÉ où  schön\n\tß", "x" * 50 + " y", "我们 Это"])
def test_counts_are_those_of_a_plain_loop(text):
    at, n = langid.counts(text)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_counts(text)


def test_counts_of_long_texts(monkeypatch):
    text = tongue(random.Random(1), "de", 500)
    whole = langid.counts(text)
    assert dict(zip(*map(np.ndarray.tolist, whole), strict=True)) == plain_counts(text)


def test_fit_is_ftrl():
    """Each weight by the published update, coordinate by coordinate."""
    rnd = random.Random(4)
    rows = [(np.array(sorted(rnd.sample(range(12), 4))), np.array([rnd.random() for _ in range(4)])) for _ in range(30)]
    labels = np.array([rnd.randrange(3) for _ in rows])
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, c):
        if abs(z[i][c]) <= langid.L1:
            return 0.0
        return -(z[i][c] - math.copysign(langid.L1, z[i][c])) / ((langid.BETA + math.sqrt(n[i][c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(3)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = {(i, c): weight(i, c) for i in at for c in range(3)}
            score = [math.exp(sum(v * w[i, c] for i, v in zip(at, x, strict=True))) for c in range(3)]
            for i, v in zip(at, x, strict=True):
                for c in range(3):
                    g = v * (score[c] / sum(score) - (labels[k] == c))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / langid.ALPHA
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    found = langid.fit(rows, labels, 3)
    assert np.allclose(found[:12], [[weight(i, c) for c in range(3)] for i in range(12)]) and not found[12:].any()


def test_temperature_is_the_likeliest():
    random_ = np.random.default_rng(2)
    labels = random_.integers(0, 3, 400)
    logits = random_.standard_normal((400, 3)) + 1.5 * np.eye(3)[labels]
    found = langid.temperature(logits, labels)

    def loss(t):
        p = np.exp(logits * t)
        p = np.log(p / p.sum(axis=1, keepdims=True))
        doubt, right = 1 / 402, p[np.arange(400), labels]
        return -((1 - doubt) * right + doubt * (p.sum(axis=1) - right) / 2).mean()

    assert loss(found) <= min(loss(t) for t in np.geomspace(0.05, 20, 400)) + 1e-9


def test_the_trained_model_holds_the_corpus_statistics(spark):
    rnd = random.Random(3)
    data = [(k, tongue(rnd, list(TONGUES)[k % 3], rnd.randint(1, 30)), list(TONGUES)[k % 3]) for k in range(90)]
    docs = spark.createDataFrame([*data, *data[:6], (None, "12", "en"), (91, None, "en"), (92, "no label", None)], "doc_id long, text string, lang string").repartition(4)
    model = langid.Model(*langid.train(docs))
    seen, by_lang = Counter(), {}
    for _, text, lang in [*data, *data[:6]]:
        seen.update(plain_counts(text).keys())
        by_lang.setdefault(lang, []).append(set(plain_counts(text)))
    idf = np.log(97 / (1 + np.array([seen[f] for f in range(langid.DIMENSIONS)]))) + 0.05
    assert np.allclose(model.idf, idf, atol=1e-6) and model.classes == ["de", "en", "fr"]
    common = {f for rows in by_lang.values() for f in set().union(*rows) if sum(f in r for r in rows) >= langid.COMMON * len(rows)}
    assert set(np.flatnonzero(model.common)) == common
    assert all(model.predict(text)[0] == lang for _, text, lang in data if len(text) > 30)


def noise(rnd, k):
    letters = ["bcdfghjklmnpqrstvwxz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "опрстуфхцчшщ", "我你他们的是在有和人这中大"][k % 5]
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(60, 400)))


def test_the_stage_rejects_noise_and_keeps_clean_texts(spark):
    rnd = random.Random(10)
    clean = [(k, tongue(rnd, list(TONGUES)[k % 3], rnd.choice([1, 2, 5, 40, 300])), list(TONGUES)[k % 3] if k % 7 else None, "s", 1) for k in range(500)]
    odd = [(1000 + k, noise(rnd, k), ["en", None][k % 2] if k < 6 else None, "s", 1) for k in range(60)]
    none = [(2000, None, "en", None, None), (2001, "", None, "s", 0), (2002, "12 + 3 !!", "fr", "s", 0), (2002, "12 + 3 !!", "fr", "s", 0)]
    docs = spark.createDataFrame([*clean, *clean[:5], *odd, *none], DOCS).repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect())
    assert kept == sorted([k for k, *_ in clean] + [k for k, *_ in clean[:5]])


def test_many_languages_and_none(spark):
    rows = [(k, f"text number{k}x of a language", f"l{k % 260:03d}", "s", 1) for k in range(300)]
    classes, packed = langid.train(spark.createDataFrame(rows, DOCS))
    assert len(classes) == langid.MOST_LANGUAGES and set(classes) >= {f"l{k:03d}" for k in range(40)} and packed
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 1), (2, "12", None, "s", 1)], DOCS)
    assert [r["doc_id"] for r in langid.keep_known(unlabelled).collect()] == [1]
    one = spark.createDataFrame([(k, tongue(random.Random(k), "en", 20), "en", "s", 1) for k in range(50)], DOCS)
    assert langid.keep_known(one).count() == 50


def test_what_the_stage_tells_goes_on(spark):
    """Missing labels are filled and contradicted ones replaced, and that is what the last stage writes."""
    rnd = random.Random(12)
    langs = list(TONGUES)
    right = {k: langs[k % 3] for k in range(3000)}  # with few rows no score is near 1
    texts = {k: tongue(rnd, lang, 60) for k, lang in right.items()}
    label = dict(right) | dict.fromkeys(range(0, 60)) | {k: langs[(k + 1) % 3] for k in range(60, 64)}
    texts |= {3700: f"{tongue(rnd, 'de', 20)} {tongue(rnd, 'fr', 20)}", 3701: tongue(rnd, "en", 60)}
    label |= {3700: "de", 3701: "rare"}
    rows = [(k, texts[k], label[k], "s", len(texts[k])) for k in texts]
    docs = spark.createDataFrame([*rows, *rows[:3], (3800, None, None, "s", None), (3801, noise(rnd, 0), None, "s", 1)], DOCS).repartition(3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "MOST_LANGUAGES", 3)  # the fourth label is not learned, so it is not judged either
        out = corpus_pipeline.language(spark, docs, "").cache()
        found = sorted((r["doc_id"], r["lang"]) for r in out.collect())
    assert found == sorted([*(right | {3700: "de", 3701: "rare"}).items(), *[(k, right[k]) for k in range(3)]])
    last = {r["doc_id"]: r["lang"] for r in corpus_pipeline.tokens(spark, corpus_pipeline.near_duplicates(spark, out, ""), "").collect()}
    assert last == right | {3700: "de", 3701: "rare"}


def test_one_language_is_no_choice(spark):
    rows = [(k, tongue(random.Random(k), "en", 20), "en" if k else None, "s", 1) for k in range(50)]
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {k: lang for k, _, lang, *_ in rows}
