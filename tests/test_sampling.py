"""Splits and caps: exact numbers whatever the rows, and no shuffle of whole rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from proselens.operators import sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(rows, n, seed=0):
    """Keys in the order of their tickets, the first n rows."""
    return sorted(rows, key=lambda k: (hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest(), k is not None, k))[:n]


@pytest.mark.parametrize("wanted", [0, 1, 37, 499, 500, 501, 600])
def test_first_rows_are_those_of_a_full_sort(spark, wanted):
    keys = [k % 450 for k in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    found = sorted(r.k for r in sampling.first_rows(df, wanted, sampling.ticket("k"), "k").collect())
    assert found == sorted(by_hand(keys, wanted))


def test_one_key_has_most_rows(spark):
    """A key of 900 of 1,000 rows is cut inside; numbers stay exact."""
    df = spark.createDataFrame([(7 if k < 900 else k, f"text {k}") for k in range(1000)], "k long, text string").repartition(6)
    for fraction in (0.1, 0.5, 0.85, 1.0):
        marked = sampling.fraction_split(df, fraction, "k").collect()
        assert len(marked) == 1000 and len({r.text for r in marked}) == 1000
        assert sum(r.is_train for r in marked) == int(1000 * fraction)


def test_groups_nulls_and_caps(spark):
    df = spark.createDataFrame([(k if k % 9 else None, f"t{k}", k % 3) for k in range(300)], "k long, text string, label int")
    capped = sampling.class_cap(df, "label", "k", {0: 20, 1: 1000}).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in capped} == {0: 20, 1: 100}
    split = sampling.family_split(df.withColumn("family", F.concat(F.lit("f"), "label")), "family", ["f0", "f1"], "k", final=True).groupBy("family", "side").count().collect()
    assert {(r["family"], r["side"]): r["count"] for r in split} == {("f0", "train"): 80, ("f0", "heldout"): 20, ("f1", "train"): 80, ("f1", "heldout"): 20, ("f2", "train"): 100}
    keys = sampling.group_split(df.withColumn("g", F.when(F.col("k") > 30, F.col("k") % 40)), "g").collect()
    assert len(keys) == 300 and len({r.g for r in keys if r.is_test}) == 41 // 10
    assert not {r.g for r in keys if r.is_test} & {r.g for r in keys if not r.is_test}


def test_no_shuffle_of_whole_rows(spark):
    df = spark.createDataFrame([(k, "text " * 20, k % 3, f"g{k % 40}") for k in range(400)], "k long, text string, label int, g string")
    for marked in (sampling.fraction_split(df, 0.85, "k"), sampling.group_split(df, "g"), sampling.class_cap(df, "label", "k", {0: 20, 1: 30}), sampling.mark_first(df, 9, sampling.ticket("k"), "k")):
        plan = plan_of(marked)
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Sort" not in plan, plan
