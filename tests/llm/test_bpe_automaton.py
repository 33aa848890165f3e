"""The automaton against the tokenizers library, on the given file and on small vocabularies."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from proselens.llm import bpe_automaton as B

TEXTS = [
    None, "", "   ", "a", "don't you'LL we'Re 'S", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext", "ÀÉ  ́x y z", "é ́a", "漢字かな ｆ 🚀🚀‍",
    "İstanbul ΑΣ ẞß ﬁ", "\x00 a\x85b\tc\r\nd", "1234 5a6 ²³ ªº", "aaaaaaa" * 400, "lowercaseword" * 900, "word " * 30_000, "!!!'s a'll", "ñandú où naïve Übermaß",
]


def want(texts):
    tokenizer = Tokenizer.from_file(B.model_path())
    found = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return found, [tokenizer.decode(ids, skip_special_tokens=False) for ids in found]


def test_digest_is_that_of_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    ids, texts = want([r[1] for r in rows])
    hashed = [(r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for r, i, t in zip(rows, ids, texts, strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in B.digest(docs).collect()), key=key) == sorted(hashed, key=key)
    back = B.decode(B.encode(docs.where("doc_id is not null"))).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r[0], t) for r, t in zip(rows, texts, strict=True) if r[0] is not None)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids, _ = want([r.text for r in rows])
    found = {r.doc_id: r.ids for r in B.encode(docs).collect()}
    assert found == {r.doc_id: i for r, i in zip(rows, ids, strict=True)}


def test_no_rows(spark):
    assert B.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies(seed):
    """Random merges of few letters, doubled ones among them, which spell many words in several ways."""
    draw = random.Random(seed)
    symbols = list("abc"[: draw.randint(1, 3)])
    merges, names = [], list(symbols)
    while len(merges) < draw.randint(1, 25):
        u, v = draw.choice(names), draw.choice(names)
        if u + v in names:
            if len(merges) > 8:
                break
            continue
        merges.append((u, v))
        names.append(u + v)
    library = Tokenizer(models.BPE({n: k for k, n in enumerate(names)}, merges))
    automaton = B.Automaton(symbols, merges)
    words = ["".join(draw.choice(symbols) for _ in range(draw.randint(1, 30))) for _ in range(300)]
    spelt = [[symbols.index(c) for c in w] for w in words]
    labels, sizes = automaton.encode(np.array([s for w in spelt for s in w]), np.array([len(w) for w in words]))
    ends = np.cumsum(sizes)
    for word, own, end, size in zip(words, spelt, ends, sizes, strict=True):
        right = library.encode(word).ids
        assert labels[end - size : end].tolist() == right, word
        assert automaton.encode_long(own) == right


def test_automaton_accepts_one_spelling():
    """Of all spellings of a word the automaton accepts one; checked by walking all of them."""
    merges = [("a", "b"), ("a", "a"), ("aa", "ab"), ("b", "b"), ("ab", "b"), ("aa", "aa")]
    automaton = B.Automaton(["a", "b"], merges)

    def spellings(word, state=0):
        if not word:
            yield []
        for label, name in enumerate(automaton.names):
            if word.startswith(name) and automaton.has(np.array([state]), np.array([label]))[0]:
                for rest in spellings(word[len(name) :], int(automaton.target[label])):
                    yield [label, *rest]

    library = Tokenizer(models.BPE({n: k for k, n in enumerate(automaton.names)}, merges))
    for length in range(1, 9):
        for bits in range(1 << length):
            word = "".join("ab"[bits >> i & 1] for i in range(length))
            assert list(spellings(word)) == [library.encode(word).ids]


def test_unproper_merges_are_refused():
    for merges in ([("a", "bc")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError):
            B.Automaton(["a", "b", "c"], merges)


def test_chunks_in_one_call():
    model = B.load(B.model_path())
    chunks = ["", "Hello,", "a b", "x<|endoftext|>y", "", "Wörld!!1", "日本"]
    ids, sizes = model.chunks(pa.array(chunks))
    right, _ = want(chunks)
    assert sizes.tolist() == list(map(len, right)) and ids.tolist() == [i for r in right for i in r]
