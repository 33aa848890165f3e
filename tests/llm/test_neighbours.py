"""Nearest neighbours against brute force: recall, order, ties, lengths, short tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselens.llm import vptree

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(data, k=20, every=20):
    """query -> [(score, id)] best first, among rows of the query's length."""
    good = [(i, np.array(v, np.float64)) for i, v, *_ in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    wanted = {}
    for i, q in good:
        if i is not None and i % every == 0:
            ranked = sorted((-float((q * v).sum()), vptree.NO_ID if j is None else j) for j, v in good if j != i and len(v) == len(q))
            wanted[i] = [(-s, None if j == vptree.NO_ID else j) for s, j in ranked[:k]]
    return wanted


def searched(spark, data, **options):
    df = spark.createDataFrame(data, VECTORS).withColumn("shard", F.lit("clash")).repartition(3)
    found = defaultdict(list)
    for r in sorted(vptree.search(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def rows(n=600, length=16, seed=5):
    random = np.random.default_rng(seed)
    base = random.standard_normal((40, length))
    return [(k, (base[k % 40] + random.standard_normal(length) * random.choice([0.1, 0.25, 0.6])).astype(np.float32).tolist(), 0) for k in range(n)]


ODD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]


def test_factor_one_is_exact(spark):
    data = rows() + [(1000 + 20 * k, v, 0) for k, v in enumerate(ODD)] + [(None, [3.0] * 16, 0), (None, [3.0] * 16, 1)]
    wanted = brute(data)
    assert any(j is None for near in wanted.values() for _, j in near)
    assert searched(spark, data, factor=1.0, shard_rows=100) == wanted


@pytest.mark.parametrize("length,unit", [(4, False), (24, False), (24, True)])
def test_recall_at_chosen_factors(spark, length, unit):
    random = np.random.default_rng(6)
    vectors = random.standard_normal((3000, length))
    if unit:
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    data = [(k, v.tolist(), 0) for k, v in enumerate(vectors.astype(np.float32))]
    wanted, found = brute(data), searched(spark, data, shard_rows=1500)
    hits = sum(len({j for _, j in wanted[q]} & {j for _, j in found[q]}) for q in wanted)
    assert hits >= 0.94 * sum(map(len, wanted.values())) and found.keys() == wanted.keys()
    assert all(len(found[q]) == 20 for q in wanted)


def test_the_factor_leaves_rows_out():
    random = np.random.default_rng(8)
    vectors = random.standard_normal((4000, 8))
    ids = np.arange(4000)
    reach = float(np.linalg.norm(vectors, axis=1).max())
    looked_at, found = [], []
    for factor in (1.0, None):
        tree = vptree.Tree(ids, vectors, reach)
        factor = factor or tree.choose_factor(20)
        tree.looked_at = 0
        found.append(tree.search(ids[:100], vectors[:100], 20, factor)[1])
        looked_at.append(tree.looked_at / (100 * 4000))
    hits = sum(len(set(a) & set(b)) for a, b in zip(found[0].tolist(), found[1].tolist(), strict=True))
    assert looked_at[1] < 0.8 * looked_at[0] and hits >= 0.94 * 2000


def test_ties_go_to_the_smaller_id(spark):
    random = np.random.default_rng(3)
    few = random.standard_normal((7, 16)).astype(np.float32).tolist()
    data = [(k, few[k % 7], 0) for k in range(420)]  # sixty copies of each: ranks are all ties
    assert searched(spark, data, shard_rows=64) == brute(data)


def test_lengths_are_searched_apart(spark):
    data = rows(100) + [(1000 + k, v, 0) for k, (_, v, _) in enumerate(rows(60, 5, 9))]
    assert searched(spark, data, factor=1.0, shard_rows=40) == brute(data)


def test_short_tables_and_none(spark):
    data = rows(7)
    assert searched(spark, data) == brute(data) and len(brute(data)[0]) == 6
    assert searched(spark, rows(1)) == {} and vptree.search(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("copies", [2])
def test_repeated_query_ids(spark, copies):
    """Rows of the query's id are its own, so none of them is its neighbour."""
    data = rows(60)
    found = searched(spark, data * copies, factor=1.0)
    wanted = {q: [x for x in near for _ in range(copies)][:20] for q, near in brute(data).items()}
    assert found == wanted
