"""Licence passages against a plain longest common subsequence, and rows that repeat."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proselens.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
NOISE = ["zebra", "quartz", "meadow", "lantern", "pebble", "saffron", "walnut", "ember"]


def words(text):
    return WORD.findall(text.translate(LOWER))


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def damaged(text, rnd):
    """One word goes, one comes, one is another, before those that tell related licences apart."""
    w = text.split()
    if len(w) > 12:
        del w[rnd.randrange(2, 6)]
        w.insert(rnd.randrange(2, 6), "granite")
        w[rnd.randrange(2, 6)] = "cobalt"
    return " ".join(w)


def noise(rnd, n):
    return " ".join(rnd.choice(NOISE) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(31)
    return [f"{noise(rnd, rnd.randint(0, 40))} {damaged(t.text, rnd)} {noise(rnd, rnd.randint(0, 40))}" for t in license_scan.LICENSES]


def test_every_passage_is_found_as_by_brute_force(spark, planted):
    df = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    templates = license_scan.BASE + license_scan.LICENSES
    found = {r["doc_id"]: r for r in license_scan.scan(df, templates).collect()}
    labels = {r["doc_id"]: r["labels"].split(",") for r in license_scan.result(df).collect()}
    for k, (text, template) in enumerate(zip(planted, license_scan.LICENSES, strict=True)):
        own, all_words = words(template.text), words(text)
        most = common(own, all_words)
        finds = [f for f in found[k]["finds"] if f["template"] == k + len(license_scan.BASE)]
        assert len(finds) == 1 and finds[0]["score"] == pytest.approx(most / len(own)), template
        first, last = finds[0]["first"], finds[0]["last"]
        assert common(own, all_words[first : last + 1]) == most and common(own, all_words[first + 1 : last + 1]) < most
        assert template.label in labels[k]
        # a related licence takes no part of the passage, a phrase of the contract may
        others = {templates[f["template"]].label for f in found[k]["finds"] if not templates[f["template"]].exact} - {template.label}
        assert not others, (template, others)


def test_copies_change_nothing(spark, planted):
    rows = [(7, planted[0]), (None, planted[3]), (8, None), (9, "")]
    for copies in (1, 5):
        df = spark.createDataFrame(rows * copies, "doc_id long, text string").withColumn("text_hash", F.lit("clash")).repartition(3)
        found = sorted((tuple(r) for r in license_scan.result(df).collect()), key=str)
        if copies == 1:
            once = found
            assert once[-2:] and {r[0]: r[6] for r in once}[7] == "mit"
        assert found == sorted(once * copies, key=str)


def test_noise_has_no_labels(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(k, noise(rnd, 200)) for k in range(20)], "doc_id long, text string")
    assert all((r["labels"], r["base_labels"], r["score"]) == ("", "", 0.0) for r in license_scan.result(df).collect())
