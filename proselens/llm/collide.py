"""Near-duplicate vectors of equal label by collision counting over one-dimensional projections.

Vectors, scaled to length one, are projected on M random lines. On each line the projections are sorted, and every vector
collides with those in the window around its own. Pairs with enough collisions are verified by their cosine. The count asked
for is calibrated to a recall: a pair right at the threshold has a known chance to share a window, so the number of shared
windows is binomial, and the count is the largest that such a pair reaches with probability RECALL.

Equal vectors of a label are one node. Nodes of a label are dealt to blocks by hash, and pairs of blocks to tasks, so a label
that holds most rows is spread; its pairs of blocks still grow with the square of its vectors, as counting does with this
method. A task returns the number of links of each node and a spanning forest of the links, never the pairs.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without label
or vectors of different lengths. Repeated rows link with each other. A null vec_id sorts first in its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bottomk import _Forest
from .components import components
from .shared import join_each, stage
from .vectors import rows_of, usable

COSINE = 0.93
#: Lines, half the width of a window, and the share of pairs at the threshold that must reach the count.
M, HALF_WINDOW, RECALL = 16, 0.6, 0.9999
BLOCK = 2048


def least_count(cosine: float = COSINE, m: int = M, half: float = HALF_WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    spread = math.sqrt(2 - 2 * cosine)  # the difference of two projections is normal with the pair's distance
    p = math.erf(half / spread / math.sqrt(2))
    at_least = 0.0
    for count in range(m, -1, -1):
        at_least += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if at_least >= recall:
            return count
    return 0


def collisions(a: np.ndarray, b: np.ndarray, half: float = HALF_WINDOW) -> np.ndarray:
    """How many windows centred on rows of ``a`` each row of ``b`` is in. Columns are lines."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    flat = counts.reshape(-1)
    for own, other in zip(a.T, b.T, strict=True):
        order = np.argsort(other, kind="stable")
        ranked = other[order]
        low, high = np.searchsorted(ranked, own - half), np.searchsorted(ranked, own + half, side="right")
        sizes = high - low
        ends = np.cumsum(sizes)
        at = order[np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])]
        flat[np.repeat(np.arange(len(a)) * len(b), sizes) + at] += 1
    return counts


def compare(left: tuple, right: tuple | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, list]:
    """(node, copies, vectors) of one block, or of two: links of each left node, of each right node, and a forest of links."""
    other = left if right is None else right
    units = [x[2] / np.linalg.norm(x[2], axis=1)[:, None] for x in (left, other)]
    lines = np.random.default_rng(7).standard_normal((left[2].shape[1], M))
    counts = collisions(units[0] @ lines, units[1] @ lines)
    if right is None:
        counts = np.triu(counts, 1)
    i, j = np.nonzero(counts >= max(1, least_count(cosine)))
    found = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):  # in double precision, on the vectors as they are
        x, y = left[2][i[k : k + (1 << 16)]], other[2][j[k : k + (1 << 16)]]
        found[k : k + (1 << 16)] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= cosine
    i, j = i[found], j[found]
    forest, edges = _Forest(), []
    for x, y in zip(left[0][i].tolist(), other[0][j].tolist(), strict=True):
        if forest.join(x, y):
            edges.append((x, y))
    links = np.bincount(i, other[1][j], len(left[0])), np.bincount(j, left[1][i], len(other[0]))
    return (links[0] + links[1], links[1] * 0, edges) if right is None else (*links, edges)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task (label, length, first, second)."""

    def flush() -> pa.RecordBatch:
        left, right = ((np.array(s[0]), np.array(s[1]), np.array(s[2])) if s[0] else None for s in sides)
        if left is None or (now[2] != now[3] and right is None):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["node", "other", "links"])
        mine, theirs, edges = compare(left, right)
        nodes = np.concatenate((left[0], right[0] if right else []), dtype=np.int64, casting="unsafe")
        links = np.concatenate((mine, theirs if right else [])).astype(np.int64)
        some = links > 0
        node = pa.array([*nodes[some].tolist(), *[a for a, _ in edges]], pa.int64())
        other = pa.array([None] * int(some.sum()) + [b for _, b in edges], pa.int64())
        return pa.RecordBatch.from_arrays([node, other, pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())], names=["node", "other", "links"])

    now, sides = None, None
    for batch in batches:
        vectors = rows_of(batch.column("vector"))
        columns = [batch.column(c).to_pylist() for c in ("label", "length", "first", "second", "side", "node", "copies")]
        for *task, side, node, copies, vector in zip(*columns, vectors, strict=True):
            if task != now:
                if now is not None:
                    yield flush()
                now, sides = task, [([], [], []), ([], [], [])]
            for part, value in zip(sides[side], (node, copies, vector), strict=True):
                part.append(value)
    if now is not None:
        yield flush()


def find(nodes: DataFrame) -> DataFrame:
    """nodes: node, label, copies, vector. Returns node, other, links: counts (other null), and links that connect (links 0)."""
    sized = nodes.withColumn("length", F.size("vector"))
    blocks = sized.groupBy("label", "length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sized.join(blocks, ["label", "length"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "length", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "vector")
    task = ["label", "length", "first", "second"]
    return dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(_count, "node long, other long, links long")


def classify(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")) & F.col("label").isNotNull(), F.col("vector")))
    rows = stage(rows.withColumn("hash", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    key = ["label", "hash", "vector"]
    nodes = stage(rows.where("vector IS NOT NULL").groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "row")).alias("least")).withColumn("node", F.col("least.row")), "nodes")
    found = stage(find(nodes.select("node", "label", "copies", "vector")), "found")
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stage(classes.select(*key, "root", "least", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "rooted")
    least = classes.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("n"))
    classes = join_each(classes, least, "root", classes.count()).select(*key, "n_links", F.col("best.vec_id").alias("component_id"))
    linked = rows.where("vector IS NOT NULL").join(classes, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
