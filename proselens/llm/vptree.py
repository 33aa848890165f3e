"""Nearest neighbours by largest inner product with vantage-point trees, one a shard.

Candidates get one more component that gives all of them the same length, and queries are scaled to that length; the largest
inner product is then the smallest distance, for which the triangle inequality holds. A vantage point is the one of a few rows
whose distances to a sample of its node spread most; the child nearer to a query is visited first. A vantage point's children
are the rows within its middle distance m and those beyond. By the triangle inequality, of a query at distance d from the point
no row of the other child is nearer than |d - m|: that child is left out if ``factor`` times |d - m| is more than the distance of
the k-th neighbour found so far. Factor one leaves out only what can't hold a neighbour, and is exact.

Vectors of each length are searched among their like. They are dealt to shards by hash, each about SHARD rows. The queries
go to every shard of their length: a task reads the rows of its shard, builds the tree, and answers queries as they stream by,
so it holds one tree and one batch of queries. Shards' neighbours are then merged for each query.

Scores are sums over the original vectors, in the same order for every pair, so equal vectors tie exactly.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part. A row without id is no query, but a
candidate, of the smallest id (the number -2**63 is read as no id). Rows with the query's id count as its own. Of several rows with one query id the smallest vector of each length is searched; a repeated
candidate stands as often as it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stage
from .vectors import rows_of, usable

SHARD = 8192
#: What a missing id is within a task.
NO_ID = -(1 << 63)
LEAF = 64
#: Rows of a node that are tried as its vantage point, and rows to which their distances are looked at.
TRIED, LOOKED_AT = 16, 128
#: Factors to choose from, the recall that a shard's sample must reach, and rows in that sample. Recall and the share of rows
#: looked at, measured against brute force, are in the README.
FACTORS, RECALL, SAMPLE = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0, 20.0), 0.95, 64


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float, leaf: int = LEAF):
        """``reach``: the largest norm of any candidate in any shard."""
        self.ids, self.vectors, self.reach = ids, vectors, reach
        rest = np.sqrt(np.maximum(reach * reach - (vectors * vectors).sum(1), 0))
        self.points = np.concatenate((vectors, rest[:, None]), axis=1)
        self.leaf, self.random = leaf, np.random.default_rng(11)
        self.looked_at = 0  # pairs of query and candidate that were scored
        self.root = self._build(np.arange(len(ids)))

    def _vantage_point(self, rows: np.ndarray) -> np.ndarray:
        tried = self.points[self.random.choice(rows, min(TRIED, len(rows)), replace=False)]
        some = self.points[self.random.choice(rows, min(LOOKED_AT, len(rows)), replace=False)]
        return tried[np.argmax(np.linalg.norm(tried[:, None] - some, axis=2).std(axis=1))]

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = self._vantage_point(rows)
        away = np.linalg.norm(self.points[rows] - point, axis=1)
        middle = float(np.median(away))
        inside = away <= middle
        if inside.all():  # equal distances: nothing to split by
            return rows
        return point, middle, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Inner products and rows (-1: none) of the k nearest of each query, nearest first, ties to the smaller id."""
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1)
        lengths = np.linalg.norm(queries, axis=1)
        scaled = np.concatenate((queries * (self.reach / lengths)[:, None], np.zeros((len(ids), 1))), axis=1)
        self._visit(self.root, np.arange(len(ids)), ids, queries, scaled, lengths, factor)
        return self.best, self.found

    def choose_factor(self, k: int, recall: float = RECALL) -> float:
        """The largest factor at which a sample of rows finds ``recall`` of their k nearest in this tree."""
        some = self.random.choice(len(self.ids), min(SAMPLE, len(self.ids)), replace=False)
        scores = self.vectors[some] @ self.vectors.T
        scores[self.ids[some][:, None] == self.ids] = -np.inf
        there = np.sort(scores, axis=1)[:, -k:]
        there[there > -np.inf] -= 1e-9 * self.reach**2

        def enough(factor: float) -> bool:
            best, _ = self.search(self.ids[some], self.vectors[some], k, factor)
            return (best >= there[:, :1]).sum() >= recall * np.isfinite(there).sum()

        low, high = 0, len(FACTORS)  # factor one is exact
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if enough(FACTORS[middle]) else (low, middle)
        return FACTORS[low]

    def _radius(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The distance of the worst neighbour found so far."""
        worst = self.best[at, -1] * self.reach / lengths[at]
        return np.sqrt(np.maximum(2 * self.reach * self.reach - 2 * worst, 0))

    def _visit(self, node, at: np.ndarray, ids, queries, scaled, lengths, factor: float) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, at, ids, queries)
            return
        point, middle, inside, outside = node
        away = np.linalg.norm(scaled[at] - point, axis=1)
        near = away <= middle
        more = (ids, queries, scaled, lengths, factor)
        self._visit(inside, at[near], *more)
        self._visit(outside, at[~near], *more)
        # what lies beyond the shell is at least this far away; the slack covers rounding
        gap = np.abs(away - middle) - 1e-9 * self.reach
        open_ = gap * factor <= self._radius(at, lengths)
        self._visit(outside, at[near & open_], *more)
        self._visit(inside, at[~near & open_], *more)

    def _leaf(self, rows: np.ndarray, at: np.ndarray, ids, queries) -> None:
        for a in range(0, len(rows), 1024):
            self._score(rows[a : a + 1024], at, ids, queries)

    def _score(self, rows: np.ndarray, at: np.ndarray, ids, queries) -> None:
        self.looked_at += len(at) * len(rows)
        rough = queries[at] @ self.vectors[rows].T
        slack = 1e-9 * self.reach * np.linalg.norm(queries[at], axis=1)
        wanted = (rough >= (self.best[at, -1] - slack)[:, None]) & (ids[at][:, None] != self.ids[rows])
        better = wanted.any(axis=1)
        at, wanted = at[better], wanted[better]
        if not len(at):
            return
        i, j = np.nonzero(wanted)
        scores = np.full(wanted.shape, -np.inf)
        scores[i, j] = (queries[at[i]] * self.vectors[rows[j]]).sum(axis=1)
        all_scores = np.concatenate((self.best[at], scores), axis=1)
        all_rows = np.concatenate((self.found[at], np.broadcast_to(rows, (len(at), len(rows)))), axis=1)
        key = np.where((all_rows >= 0) & (all_scores > -np.inf), self.ids[all_rows], np.iinfo(np.int64).max)
        order = np.lexsort((key, -all_scores), axis=1)[:, : self.best.shape[1]]
        self.best[at] = np.take_along_axis(all_scores, order, 1)
        self.found[at] = np.where(self.best[at] > -np.inf, np.take_along_axis(all_rows, order, 1), -1)


def _answer(k: int, factor: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, vectors = None, None, [], []
        for batch in batches:
            lengths, shards, reach = (batch.column(c).to_numpy() for c in ("length", "shard", "reach"))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            own, rows = batch.column("vec_id").to_numpy(), rows_of(batch.column("vector"))
            # runs of equal shard and kind
            cut = np.flatnonzero((np.diff(lengths) != 0) | (np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1 if len(shards) else []
            for a, b in zip([0, *cut], [*cut, len(shards)], strict=True):
                if a == b:
                    continue
                if (lengths[a], shards[a]) != shard:
                    shard, tree, ids, vectors = (lengths[a], shards[a]), None, [], []
                if not asks[a]:
                    ids.append(own[a:b])
                    vectors += rows[a:b]
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.array(vectors), reach[a])
                    own_factor = factor or tree.choose_factor(k)
                for c in range(a, b, 1024):
                    query, d = own[c : min(b, c + 1024)], min(b, c + 1024)
                    best, found = tree.search(query, np.array(rows[c:d]), k, own_factor)
                    i, j = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(tree.ids[found[i, j]]), pa.array(best[i, j])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, factor: float | None = None, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by ``every``, among all other rows."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    rows = stage(rows.withColumn("length", F.size("vector")), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    shards = F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")
    lengths = stage(rows.groupBy("length").agg(shards, (F.sqrt(F.max(squares)) * (1 + 1e-12)).alias("reach")), "lengths")
    rows = rows.join(small(lengths), "length")
    held = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int"), "asks": F.lit(False)})
    queries = rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).groupBy("length", "vec_id", "shards", "reach").agg(F.min("vector").alias("vector"))
    asking = queries.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), "asks": F.lit(True)})
    task = ["length", "shard"]
    parts = lengths.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    both = held.select(*task, "asks", "reach", "vec_id", "vector").unionByName(asking.select(*task, "asks", "reach", "vec_id", "vector"))
    dealt = both.repartitionByRange(parts, *task).sortWithinPartitions(*task, "asks", "vec_id")
    found = dealt.mapInArrow(_answer(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
