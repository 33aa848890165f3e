"""Phrases against counting by hand, and against the registered SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from proselens.llm import phrases

DOCS = "doc_id long, text string, lang string, n long, g string"


def by_hand(rows, least, top, longest=5):
    pieces = []
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        pieces += [(lang or "und", re.findall(r"[^ \t]+", p)) for p in re.split(r"[.,;:!?\n-\r]", low)]
    total, f = Counter(), Counter()
    for lang, words in pieces:
        total[lang] += len(words)
        for k in range(1, longest + 1):
            for i in range(len(words) - k + 1):
                f[lang, tuple(words[i : i + k])] += 1
    found = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    held = {(lang, w[i : i + k]) for (lang, w), n in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * n >= 100 * f[lang, w[i : i + k]]}
    best = []
    for (lang, w), a in found.items():
        if (lang, w) not in held:
            score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            best.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], total[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(best):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return sorted(tuple(r) for r in phrases.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=120, words=9):
    draw = random.Random(seed)
    vocabulary = ["Ab", "ab", "b", "çé", "x-y", "d'e", "0", "(q)", "Z"][:words]
    fixed = ["one two three four five six seven eight nine ten", "ha ha ha ha ha ha ha ha", "of the"]
    rows = []
    for i in range(n):
        parts = [draw.choice(vocabulary) if draw.random() < 0.9 else draw.choice(fixed) for _ in range(draw.randint(0, 30))]
        text = "".join(p + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; ", "\r\n", "\x0b"]) for p in parts)
        rows.append((i, text, draw.choice(["en", "de", None, "und"]), i, "clash"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_by_hand(spark, seed):
    rows = corpus(seed)
    assert mined(spark, rows, least=3 + seed, top=40) == by_hand(rows, 3 + seed, 40)


def test_awkward_rows(spark):
    rows = corpus(7, 40) + [(None, None, None, None, None), (1, "", "en", 1, ""), (1, " . ,;", "fr", 1, ""), (2, "same words here. " * 6, "en", 1, ""), (2, "same words here. " * 6, "en", 1, "")]
    rows += [(9, "long text of many words with no end " * 20_000, "en", 1, ""), (10, "wordwithoutgap" * 40_000, "fr", 1, "")]
    want = by_hand(rows, 4, 50)
    assert mined(spark, rows, least=4, top=50) == want
    # without cutting pieces at rare words or pairs, and with hashes that clash at first
    assert mined(spark, rows, least=4, top=50, most_kept=0) == want
    assert mined(spark, rows, least=4, top=50, bits=10) == want


def test_nothing_found(spark):
    assert mined(spark, [], least=2) == [] and mined(spark, [(1, None, None, 1, ""), (2, "a b", "en", 1, "")], least=2) == []


def test_paths_are_compacted(spark):
    """A passage of twelve words is one path; a fork in it makes three."""
    base = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(base), "en", 1, "") for i in range(5)]
    for extra, want in (([], [(12, 5)]), ([(9, " ".join([*base[:7], *(f"v{k}" for k in range(6))]), "en", 1, "")] * 5, [(7, 10), (9, 5), (10, 5)])):
        words, _, hashed = phrases.word_counts(df := spark.createDataFrame(rows + extra, DOCS), 5)
        found = phrases.paths(phrases.flows(df, words, hashed, 5)).collect()
        assert sorted((len(r.g), r.n) for r in found) == want


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    path = Path(folder, "documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    want = con.sql(phrases.ORACLE).order("lang, rank").fetchall()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert want and sorted(tuple(r[c] for c in names) for r in phrases.mine(spark.read.parquet(str(path))).collect()) == want
