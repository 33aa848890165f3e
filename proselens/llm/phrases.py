"""Phrases of a corpus by a weighted de Bruijn graph of words, scored by how much more often their parts meet than by chance.

Texts are cut into pieces at punctuation and line ends, pieces into words. The graph's edges are runs of five words, its nodes
runs of four; an edge weighs as many places as its run stands at. At the end of a piece runs are shorter: those are kept apart.
A shorter run's count is its flow: the weights of all edges that begin with it and of all piece ends that do. Where one edge
carries all that flows into a node and one edge all that flows out, the node is on a unary path; paths are compacted by pointer
doubling, and the candidates of five words are read off them. A run that a longer one holds as often, by its first or its last
words, is no candidate, as it is a place on the longer one's way.

Two exact cuts come first, as a run with a word or a pair of words below the least count can't be a candidate: pieces are cut at
such words and pairs. Words and pairs that stay are broadcast if they are at most MOST_KEPT; beyond that pieces are not cut,
which gives the same result for more shuffling.

A word is a 64-bit hash of its bytes and language. Two words of one hash are found when words are counted, by a second hash and
by the words themselves, and counting begins anew with another hash. Pairs are counted by a hash as well; there, two pairs of one
hash are only cut later than they might be.

Rows: null or blank texts have no words; a null language is ``und``. Repeated rows count as often as they stand. Texts of any
length are read whole. Ties of score and count are ranked by the phrase's bytes. A table without rows, or without candidates,
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .shared import small, stage
from .token_files import slices

#: Least count of a candidate, most words of one, phrases given for a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Words, and pairs of words, up to which they are broadcast; bytes of texts looked at together; entries of a task's counts.
MOST_KEPT, SLICE, ENTRIES = 2_000_000, 500_000, 100_000
#: Parts that a language's candidates are ranked in first, so that none is ranked by one task.
PARTS = 64

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _SEPARATES.copy()
_GAP[[0x20, 0x09]] = True
_ROWS = 20_000  # of a batch that is given to Spark


class Words:
    """The words of some texts in order: hashes, where each begins and ends in the texts' bytes, whether it begins a piece, its text."""

    def __init__(self, texts: pa.Array, tags: np.ndarray, salt: int, bits: int):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = (np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
        starts, self._separators = offsets[:-1] - offsets[0], 0
        found = [self._segment(a, b, starts, salt) for a, b in self._segments(starts)]
        one, two, self.first, self.last, gaps = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 5))
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        tag = tags[self.text] if len(self.text) else np.empty(0, np.uint64)
        self.hash, self.second = (W.mix(x.astype(np.uint64) + tag) for x in (one, two))
        if bits < 64:
            self.hash &= np.uint64((1 << bits) - 1)
        self.begins = np.ones(len(self.text), bool)
        self.begins[1:] = (np.diff(self.text) != 0) | (np.diff(gaps) != 0)

    def _segments(self, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(self.data):
            to = min(len(self.data), at + W.SEGMENT)
            while to < len(self.data):  # to the next gap or text
                look = min(len(self.data), to + W.SEGMENT)
                gap = np.flatnonzero(_GAP[self.data[to:look]])
                text = np.searchsorted(starts, to)
                ends = [to + int(g) for g in gap[:1]] + [int(s) for s in starts[text : text + 1] if s < look]
                to = min(ends, default=look)
                if ends:
                    break
            yield at, to
            at = to

    def _segment(self, a: int, b: int, starts: np.ndarray, salt: int):
        part = self.data[a:b]
        gap = _GAP[part]
        heads = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        begin = np.empty(len(part) + 1, bool)
        begin[0] = begin[-1] = True
        begin[1:-1] = gap[:-1]
        begin[heads] = True
        first = np.flatnonzero(begin[:-1] & ~gap)
        ends = np.append(gap, True)
        ends[heads] = True
        stop = np.flatnonzero(ends)
        last = stop[np.searchsorted(stop, first, side="right")]
        lowered = W.LOWER[part].astype(np.uint64) + np.uint64(1)
        hashes = []
        for base in (0x9E3779B97F4A7C15 + 2 * salt | 1, 0xD1342543DE82EF95):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(lowered * W._power(base, len(part))[: len(part)], out=total[1:])
            hashes.append(W.mix((total[last] - total[first]) * W._power(pow(base, -1, 1 << 64), len(part))[first]))
        # separators before each word, in all of the texts
        before = np.cumsum(_SEPARATES[part])
        gaps = self._separators + before[first]
        self._separators += int(before[-1])
        return (*hashes, first + a, last + a, gaps)

    def spelt(self, k: int) -> str:
        return W.LOWER[self.data[self.first[k] : self.last[k]]].tobytes().decode()


def _tag(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _read(batches: Iterator[pa.RecordBatch], salt: int, bits: int) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of slices, and the languages of their texts, as places in a list."""
    for batch in batches:
        texts, langs = pc.fill_null(batch.column("text"), ""), pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        tags = np.array([_tag(x) for x in names], np.uint64)[which] if names else np.empty(0, np.uint64)
        for a, b in slices(texts, SLICE):
            yield Words(texts[a:b], tags[a:b], salt, bits), which[a:b], names


def _count_words(salt: int, bits: int):
    """h, lang, word, n, clash; and for each language the number of its words, under a null word."""

    def rows(known: np.ndarray, counts: np.ndarray, spelt: dict, clash: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(known), _ROWS):
            own = known[a : a + _ROWS]
            names = [spelt[h] for h in own.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string()), pa.array(counts[a : a + _ROWS], pa.int64()), pa.array(np.full(len(own), clash))],
                names=["h", "lang", "word", "n", "clash"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        none = np.empty(0, np.uint64)
        known, second, counts, spelt, clash = none, none, np.empty(0, np.int64), {}, False
        for words, langs, names in _read(batches, salt, bits):
            lang = langs[words.text]
            for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                if n:
                    totals[names[k]] = totals.get(names[k], 0) + n
            order = np.argsort(words.hash, kind="stable")
            h, s = words.hash[order], words.second[order]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            clash |= bool((~head[1:] & (s[1:] != s[:-1])).any())
            at = np.flatnonzero(head)
            h, s, n, first = h[at], s[at], np.diff(np.append(at, len(order))), order[at]
            place = np.searchsorted(known, h)
            old = place < len(known)
            old[old] = known[place[old]] == h[old]
            clash |= bool((second[place[old]] != s[old]).any())
            counts[place[old]] += n[old]
            for x, k in zip(h[~old].tolist(), first[~old].tolist(), strict=True):
                spelt[x] = names[lang[k]], words.spelt(k)
            known, second, counts = np.concatenate((known, h[~old])), np.concatenate((second, s[~old])), np.concatenate((counts, n[~old]))
            order = np.argsort(known)
            known, second, counts = known[order], second[order], counts[order]
            if len(known) > ENTRIES:
                yield from rows(known, counts, spelt, clash)
                known, second, counts, spelt = none, none, np.empty(0, np.int64), {}
        yield from rows(known, counts, spelt, clash)
        langs = list(totals)
        tags = np.array([_tag(x) for x in langs], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(list(totals.values()), pa.int64()), pa.array([clash] * len(langs), pa.bool_())], names=["h", "lang", "word", "n", "clash"])

    return run


def word_counts(docs: DataFrame, least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """h, lang, word, n of the words with at least ``least`` places; lang, n of all words; the hash's salt and bits."""
    for salt in range(100):
        rows = docs.select("text", "lang").mapInArrow(_count_words(salt, bits), "h long, lang string, word string, n long, clash boolean")
        total = F.col("word").isNull()
        named = F.struct("lang", "word")
        counted = rows.groupBy("h", total.alias("total")).agg(F.sum("n").alias("n"), F.min(named).alias("x"), (F.max("clash") | (F.min(named) != F.max(named))).alias("clash"))
        counted = stage(counted.where(F.col("total") | (F.col("n") >= least) | F.col("clash")).select("h", "x.lang", "x.word", "n", F.coalesce("clash", F.lit(False)).alias("clash")), "words")
        if counted.where("clash").isEmpty():
            return counted.where("word IS NOT NULL").select("h", "lang", "word", "n"), counted.where("word IS NULL").select("lang", "n"), (salt, bits)
        bits = min(64, bits + 8)
    raise ValueError("no hash without clashes")


def _kept(rows: DataFrame, column: str, most: int):
    """The values of a column for all tasks, sorted; None if there are too many."""
    if rows.count() > most:
        return None
    values = rows.select(column).toArrow().column(0).to_numpy().astype(np.int64)
    return rows.sparkSession.sparkContext.broadcast(np.sort(values.view(np.uint64)))


def _among(values: np.ndarray, kept) -> np.ndarray:
    if kept is None:
        return np.ones(len(values), bool)
    if not len(kept.value):
        return np.zeros(len(values), bool)
    return kept.value[np.minimum(np.searchsorted(kept.value, values), len(kept.value) - 1)] == values


def _pairs(words: Words, kept) -> tuple[np.ndarray, np.ndarray]:
    """For each word but the first, whether it may follow the one before, and a hash of both."""
    some = _among(words.hash, kept)
    linked = ~words.begins[1:] & some[1:] & some[:-1]
    return linked, W.mix(words.hash[:-1] * np.uint64(0xA0761D6478BD642F) + words.hash[1:])


def _count_pairs(salt: int, bits: int, kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["p", "n"])

        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for words, *_ in _read(batches, salt, bits):
            linked, pairs = _pairs(words, kept)
            own, n = np.unique(pairs[linked], return_counts=True)
            both, at = np.unique(np.concatenate((keys, own)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
            keys = both
            if len(keys) > ENTRIES:
                yield give(keys, counts)
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield give(keys, counts)

    return run


def _count_runs(salt: int, bits: int, kept, kept_pairs, longest: int):
    """w1, w2, ... n: the longest run at each place of a piece, of two words at least; short ones end with nulls."""
    names = [f"w{k}" for k in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, *_ in _read(batches, salt, bits):
            linked, pairs = _pairs(words, kept)
            linked &= _among(pairs, kept_pairs)
            follows = np.concatenate((linked, np.zeros(longest, bool)))  # the k-th word is followed in its piece
            length, on = np.ones(len(words.hash), np.int64), np.ones(len(words.hash), bool)
            for k in range(longest - 1):
                on &= follows[k : k + len(on)]
                length += on
            at = np.flatnonzero(length > 1)
            if not len(at):
                continue
            padded = np.concatenate((words.hash, np.zeros(longest, np.uint64)))
            runs = np.stack([np.where(length[at] > k, padded[at + k], np.uint64(0)) for k in range(longest)], 1)
            key = length[at].astype(np.uint64)
            for column in runs.T:
                key = W.mix(key * np.uint64(0xE7037ED1A0B428DB) + column)
            _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if not ((runs[first][which] == runs).all() and (length[at][first][which] == length[at]).all()):  # two runs of one key: nothing is added up here
                first, n = np.arange(len(at)), np.ones(len(at), np.int64)
            own, size = runs[first].view(np.int64), length[at][first]
            yield pa.RecordBatch.from_arrays([*[pa.array(own[:, k], mask=size <= k) for k in range(longest)], pa.array(n, pa.int64())], names=[*names, "n"])

    return run, names


def flows(docs: DataFrame, words: DataFrame, hashed: tuple[int, int], least: int = LEAST, longest: int = LONGEST, most_kept: int = MOST_KEPT) -> DataFrame:
    """g (hashes of words), n: edges, nodes and shorter runs of two words at least that have at least ``least`` places."""
    texts = docs.select("text", "lang")
    kept = _kept(words, "h", most_kept)
    kept_pairs = None
    if kept is not None:
        pairs = texts.mapInArrow(_count_pairs(*hashed, kept), "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
        kept_pairs = _kept(stage(pairs.where(F.col("n") >= least).select("p"), "pairs"), "p", most_kept)
    run, names = _count_runs(*hashed, kept, kept_pairs, longest)
    runs = texts.mapInArrow(run, ", ".join(f"{w} long" for w in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    # an edge or a piece's end flows through all its beginnings
    begins = F.array(*[F.when(F.col(names[k - 1]).isNotNull(), F.array(*names[:k])) for k in range(2, longest + 1)])
    each = runs.select(F.explode(F.array_compact(begins)).alias("g"), "n")
    return stage(each.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "flows")


def paths(flow: DataFrame, longest: int = LONGEST) -> DataFrame:
    """g, n: the words of every unary path (an edge by itself is one, too), and how often it is gone.

    Heads are found by pointer doubling: an edge takes the head of its head, so rounds grow with the logarithm of a path. No
    path is a ring, as what flows on it came from the beginning of some piece.
    """
    edges, nodes = flow.where(F.size("g") == longest), flow.where(F.size("g") == longest - 1)
    into = edges.select(F.slice("g", 2, longest - 1).alias("node"), "n", F.col("g").alias("before"))
    out = edges.select(F.slice("g", 1, longest - 1).alias("node"), "n", "g")
    # one edge carries all into the node, one edge all out of it
    unary = out.join(nodes.select(F.col("g").alias("node"), "n"), ["node", "n"]).join(into, ["node", "n"]).select("g", "before")
    state = edges.join(unary, "g", "left").select("g", "n", F.coalesce("before", "g").alias("head"), F.col("before").isNotNull().cast("long").alias("far"))
    state, far = stage(state, "paths"), -1
    while (now := state.agg(F.coalesce(F.sum("far"), F.lit(0))).first()[0]) != far:
        far = now
        heads = state.select(F.col("g").alias("head"), F.col("head").alias("further"), F.col("far").alias("more")).where("more > 0")
        moved = state.join(heads, "head", "left").select("g", "n", F.coalesce("further", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        state = stage(moved, "paths")
    ends = F.array_sort(F.collect_list(F.struct("far", F.element_at("g", longest).alias("w"))))
    grouped = state.groupBy("head").agg(F.first("n").alias("n"), ends.alias("ends"))
    return grouped.select(F.concat(F.slice("head", 1, longest - 1), F.transform("ends", lambda x: x["w"])).alias("g"), "n")


def candidates(flow: DataFrame, longest: int = LONGEST) -> DataFrame:
    """g, n: the runs of two words at least that no longer one holds as often."""
    along = paths(flow, longest).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("g") - longest + 1), lambda k: F.slice("g", k, longest))).alias("g"), "n")
    inner = flow.where(F.size("g") > 2).select(F.explode(F.array(F.slice("g", F.lit(1), F.size("g") - 1), F.slice("g", F.lit(2), F.size("g") - 1))).alias("g"), "n").distinct()
    return along.unionByName(flow.where(F.size("g") < longest).join(inner, ["g", "n"], "left_anti"))


def _whole(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(T.DecimalType(19, 0))


def scored(found: DataFrame, flow: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: of each candidate its cut of the lowest score, the first of equal ones."""
    parts = small(stage(flow.select("g", "n").unionByName(words.select(F.array("h").alias("g"), "n")), "parts"))
    named, totals = small(words.select("h", "lang", "word")), small(totals)
    lang = named.select(F.col("h").alias("__first"), "lang")
    rows = found.withColumnRenamed("n", "a").withColumn("__first", F.element_at("g", 1)).join(lang, "__first").join(totals, "lang").drop("__first")
    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("g") - 1)))
    cuts = cuts.withColumns({"left": F.slice("g", F.lit(1), F.col("k")), "right": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select(F.col("g").alias(side), F.col("n").alias(name)), side)
    # products of two longs have 38 digits at most; div leaves a whole number
    cuts = cuts.withColumns({"above": (_whole("a") * _whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), "below": _whole("l") * _whole("r")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("g", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spelt = found.select("g", F.posexplode("g").alias("k", "h")).join(named.select("h", "word"), "h").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("spelt"))
    phrase = F.array_join(F.transform("spelt", lambda x: x["word"]), " ")
    return best.join(spelt, "g").select("lang", phrase.alias("phrase"), "a", "x.l", "x.r", "n", "x.score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_kept: int = MOST_KEPT, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of ``docs`` (text, lang): each language's first ``top`` by score, count and phrase."""
    words, totals, hashed = word_counts(docs, least, bits)
    flow = flows(docs, words, hashed, least, longest, most_kept)
    rows = scored(stage(candidates(flow, longest), "candidates"), flow, words, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each language in parts first: of a part only the first ``top`` can be among the language's
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for by in ([F.col("lang"), part], [F.col("lang")]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle() -> str:
    grams = "\nUNION ALL\n".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])) AS g FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    return f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut
), counted AS (
  SELECT lang, g, count(*) AS f FROM ({grams}) GROUP BY ALL
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), found AS (
  SELECT * FROM counted WHERE f >= {LEAST} AND len(g) >= 2
), longer AS (
  SELECT DISTINCT lang, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS g, f FROM found WHERE len(g) > 2
), stay AS (
  SELECT f.* FROM found f ANTI JOIN longer x ON f.lang = x.lang AND f.g = x.g AND f.f = x.f
), cuts AS (
  SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM stay
), scores AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang JOIN counted x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN counted y ON y.lang = c.lang AND y.g = c.g[c.k + 1:len(c.g)]
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
  a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {TOP}
"""


ORACLE = _oracle()
