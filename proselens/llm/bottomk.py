"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's words make a set of shingle hashes. Documents with equal sets are one node.
2. A node's sketch is the k smallest hashes of its set. Inverted lists of the retained values count how many nodes hold each.
   Two sets as similar as the threshold share at least ``least_overlap`` retained values, so by the prefix principle they
   share one of the ``size - least_overlap + 1`` rarest values of either sketch: only those lists are joined. A value that one
   node alone holds has no list, so most nodes without a partner leave here; so do values that very many documents share.
3. The nodes of linked lists form groups. A group is cut into blocks by size class and hash, pairs of blocks that can be
   similar are dealt to tasks; there sketches' overlaps are counted, the union sketch estimates the similarity, and pairs
   that may reach the threshold are verified on their full sets. A task returns a spanning forest of the links it found,
   never all pairs, and skips pairs that it has already connected.
4. Components of the links give the classes.

Sets of up to ``percent`` % of k hashes and their partners are sketched whole, so for them the search is exact. Beyond that
``least_overlap`` lies 5.7 standard deviations below the expected number of shared values at the threshold (k = 64: 38 of
54.4 at 85 %, 32 of 51.2 at 80 %): of links right at the threshold about one in 10**7 is missed, of closer ones fewer.

Rows: null and empty texts have no shingles and link with nothing. Repeated rows link with each other; rows with the same id
share its component id. Any id may be null; null ids sort first among the ids of a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import in_slices, join_each, short_batches, small, stage

SHINGLE = 5
#: A link needs 100 * intersection >= percent * union; this is the percentage of ``result`` and its SQL.
PERCENT = 85
K = 64
#: Blocks of a group hold about so many sets and so many hashes.
BLOCK_SETS, BLOCK_HASHES = 256, 1 << 20


def least_overlap(n: int, k: int = K, percent: int = PERCENT) -> int:
    """Retained values that the sketch of a set of ``n`` shares with that of any set as similar as the threshold."""
    if 100 * n <= percent * k:
        return -(-percent * n // 100)
    t = percent / 100
    return math.floor(k * t - 5.7 * math.sqrt(k * t * (1 - t)))


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    raw = [(x or "").encode() for x in texts]
    for found in words.word_hashes(raw, words.BLANK):
        yield words.shingle_set(found, SHINGLE)


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """As signed numbers in rising order: Spark and this module then agree on which hashes are smallest."""
    return np.sort(hashes.view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        n, sign, sketch = [], [], []
        for own in _sets(batch.column("text").to_pylist()):
            own = _ordered(own)
            n.append(len(own))
            sign.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sketch.append(own[:K])
        bounds = pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32())
        values = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sketch) if sketch else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(sign, pa.binary()), values], names=["doc_id", "text_hash", "n", "sign", "sketch"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 128):
        own = [_ordered(x) for x in _sets(batch.column("text").to_pylist())]
        sign = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(sign, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["sign", "hashes"])


# ---- candidates ------------------------------------------------------------------------------------------------------


def _shared_values(nodes: DataFrame) -> DataFrame:
    """node, n, sketch size, and the retained values that other nodes hold too, with how many hold them."""
    posted = nodes.select("node", F.explode("sketch").alias("value"))
    holders = posted.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    return posted.join(holders, "value")


def _least_overlap(n, percent: int):
    """``least_overlap`` as a column."""
    return F.when(100 * n <= percent * K, F.ceil(n * percent / 100)).otherwise(least_overlap(K, percent=percent)).cast("int")


def candidate_lists(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """value, node: for each node its rarest retained values, as many as the prefix principle asks for."""
    shared = _shared_values(nodes)
    held = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("held"))  # at most K
    prefix = held.join(nodes.select("node", _least_overlap(F.col("n"), percent).alias("least")), "node").where(F.size("held") >= F.col("least"))
    # values held by no one else come first in the prefix and need no list
    rare = prefix.select("node", F.explode(F.slice("held", 1, F.size("held") - F.col("least") + 1)).alias("x"))
    return rare.select("node", F.col("x.value").alias("value"))


# ---- verification ----------------------------------------------------------------------------------------------------


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _union_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the K smallest of each union (rows of a and b, sorted, padded with the largest number): how many are in both."""
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    twin = both[:, 1:] == both[:, :-1]
    twin &= both[:, 1:] != np.iinfo(np.int64).max
    rank = np.arange(1, both.shape[1]) - np.cumsum(twin, axis=1)  # of the distinct value, from 0
    return (twin & (rank < K)).sum(axis=1)


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def compare(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links between two blocks of (node, sorted hashes), or within one: a spanning forest of them."""
    forest = _Forest()
    other = left if right is None else right
    n, m = (np.array([len(x[1]) for x in side]) for side in (left, other))

    def padded(side: list) -> np.ndarray:
        out = np.full((len(side), K), np.iinfo(np.int64).max)
        for row, (_, own) in zip(out, side, strict=True):
            row[: min(K, len(own))] = own[:K]
        return out

    a, b = padded(left), padded(other)
    least = np.array([least_overlap(int(x), percent=percent) for x in n])
    for row in range(len(left)):
        near = (100 * np.minimum(n[row], m) >= percent * np.maximum(n[row], m)) & (np.arange(len(other)) > row if right is None else True)
        at = np.flatnonzero(near)
        if not len(at):
            continue
        found = _union_shared(np.broadcast_to(a[row], (len(at), K)), b[at])
        keep = found >= least[row]
        at = at[keep][np.argsort(-found[keep], kind="stable")]
        for j in at:
            x, y = left[row], other[j]
            if forest.root(x[0]) == forest.root(y[0]):
                continue
            i = _intersection(x[1], y[1])
            if 100 * i >= percent * (len(x[1]) + len(y[1]) - i):
                forest.join(x[0], y[0])
                yield x[0], y[0]


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; those of one task are compared when the next begins."""

    def flush() -> pa.RecordBatch:
        right = None if now[1] == now[2] else sides[1]
        links = list(compare(sides[0], right, percent)) if sides[0] and (right is None or right) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, sides = None, ([], [])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("group", "first", "second", "side", "node")]
        hashes = batch.column("hashes")
        for k, (group, first, second, side, node) in enumerate(zip(*columns, strict=True)):
            if (group, first, second) != now:
                if now is not None and len(sides[0]) + len(sides[1]) > 1:
                    yield flush()
                now, sides = (group, first, second), ([], [])
            sides[side].append((node, np.frombuffer(hashes[k].as_py(), np.int64)))
    if now is not None and len(sides[0]) + len(sides[1]) > 1:
        yield flush()


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """group, first, second, side, node: each pair of blocks of a group whose sizes may be similar. members: node, n, group."""
    log = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    sized = members.withColumn("class", log)  # similar sets are in the same or neighbouring classes
    cells = sized.groupBy("group", "class").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    near = cells.select("group", F.explode(F.array([F.col("class") + d for d in (-1, 0, 1)])).alias("class"), F.struct(F.col("class").alias("class"), "blocks").alias("cell"))
    around = near.groupBy("group", "class").agg(F.collect_list("cell").alias("cells"))  # three at most
    own = F.filter("cells", lambda c: c["class"] == F.col("class"))[0]["blocks"]
    block = F.pmod(F.xxhash64("node"), own).cast("int")
    name = lambda c, b: (c.cast("long") * F.lit(1 << 31) + b.cast("long"))
    mine = name(F.col("class"), F.col("block"))
    others = F.flatten(F.transform("cells", lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: name(c["class"], b))))
    dealt = sized.join(around, ["group", "class"]).withColumn("block", block).select("group", "node", mine.alias("mine"), F.explode(others).alias("other"))
    return dealt.select("group", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node")


def find_links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links that connect all similar nodes. nodes: node, n, sign, text_hash, sketch; docs: text, text_hash."""
    lists = stage(candidate_lists(nodes, percent), "lists")
    leaders = lists.groupBy("value").agg(F.min("node").alias("leader"))
    groups = components(lists.join(leaders, "value").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    members = stage(groups.select("node", F.col("root").alias("group")).join(nodes.select("node", "n", "sign", "text_hash"), "node"), "members")
    wanted = small(stage(members.select("text_hash").distinct(), "wanted"))
    full = docs.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text").mapInArrow(_full, "sign binary, hashes binary")
    sets = stage(members.select("sign", "node").join(full.dropDuplicates(["sign"]), "sign").select("node", "hashes"), "sets")
    tasks = _tasks(members.select("node", "n", "group"), percent)
    dealt = tasks.join(sets, "node").repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")
    return stage(dealt.select("group", "first", "second", "side", "node", "hashes").mapInArrow(lambda batches: _verify(batches, percent), "a long, b long"), "links")


def classify(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: row, doc_id, text_hash, n_shingles, component_id, kept and representative, for each row of docs.

    ``kept``: doc_id = component_id. ``representative``: true for exactly one row of each class (the first row of its smallest id).
    """
    texts = short_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketched = stage(texts.mapInArrow(_sketch, "doc_id long, text_hash long, n long, sign binary, sketch array<long>").withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id"), F.col("row"))).alias("first")
    copies = stage(sketched.where("n > 0").groupBy("sign").agg(first, F.count("*").alias("n")), "copies")
    nodes = copies.select(F.col("first.row").alias("node")).join(sketched.where("n > 0").select(F.col("row").alias("node"), "n", "sign", "text_hash", "sketch"), "node")
    links = find_links(stage(nodes, "nodes"), texts, percent)
    roots = stage(components(links), "roots")
    classes = copies.select("sign", "first", "n", F.col("first.row").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stage(classes.select("sign", "first", "root", F.col("n").alias("copies")), "rooted")
    best = classes.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n"))
    by_sign = stage(join_each(classes, best, "root", classes.count()).select("sign", "best", F.col("copies").alias("n")), "classes")
    rows = sketched.select("row", "doc_id", "text_hash", "sign", F.col("n").alias("n_shingles"))
    linked = join_each(rows.where("sign IS NOT NULL"), by_sign, "sign").drop("sign")
    alone = rows.where("sign IS NULL").drop("sign").withColumn("best", F.struct("doc_id", "row"))  # no words, no links
    rows = linked.unionByName(alone).select("row", "doc_id", "text_hash", "n_shingles", F.col("best.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), (F.col("row") == F.col("best.row")).alias("representative"))
    return rows, links


def result(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return classify(docs)[0].select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates; documents without shingles all stay."""
    rows, _ = classify(docs, percent)
    away = rows.where(~F.col("representative")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("__away"))
    kept = rows.where("representative").select("doc_id", "text_hash").withColumn("__kept", F.lit(True)).distinct()
    gone = away.join(kept, (away["doc_id"].eqNullSafe(kept["doc_id"])) & (away["text_hash"] == kept["text_hash"]), "left_anti")
    return _drop_rows(docs, small(stage(gone, "gone")), rows)


def _drop_rows(docs: DataFrame, gone: DataFrame, rows: DataFrame) -> DataFrame:
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__hash": F.xxhash64("text")})
    left = keyed.join(gone.select(F.col("doc_id").alias("__g"), F.col("text_hash").alias("__h")), F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__hash") == F.col("__h")), "left_anti")
    # rows equal in id and text to a kept one: one of them stays
    twins = rows.groupBy("doc_id", "text_hash").agg(F.max("n_shingles").alias("n"), F.count("*").alias("c")).where("c > 1 and n > 0")
    twins = small(stage(twins.select(F.col("doc_id").alias("__g"), F.col("text_hash").alias("__h")), "twins"))
    same = F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__hash") == F.col("__h"))
    single = left.join(twins, same, "left_anti")
    double = left.join(twins, same, "left_semi").dropDuplicates(["__id", "__hash"])
    return single.unionByName(double).drop("__id", "__hash")


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE} + 2, 2)), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * i.i >= {PERCENT} * (p.n + q.n - i.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""
