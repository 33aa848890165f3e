"""Sharding by weighted rendezvous hashing.

Every shard draws a number for a key from a hash of both; the shard with the largest weighted draw takes the key. A new shard
can only win keys, so it takes rows into itself and moves none between old shards.

Rows: equal ids go to one shard; a null id is a key of its own; a null text has size 1 and the crc32 of no bytes. Repeated
rows get slots of their own. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stage

#: Rows in a run of all shards together, about.
RUN_ROWS = 1 << 12


def draw(key: Column, shard: int, weight: float = 1.0, seed: int = 0) -> Column:
    """The shard's draw for a key, larger is better: -weight / ln(u), u uniform in (0, 1) by hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.log(u)


def shard_of(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard, from 0, of a key; ``weights`` gives each shard's. Equal draws go to the smaller shard."""
    draws = [F.struct(draw(key, i, w, seed).alias("draw"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.greatest(*draws)["shard"] if len(draws) > 1 else F.lit(0)).cast("int")


def assign(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without a gap. Rows are counted in runs dealt by a hash of what the row holds
    and of where it was read, so no key, however frequent, makes a long run; a run's first slot is the count of the shard's
    earlier runs.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights, seed).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown_weight], seed).alias("grown_shard"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = stage(rows, "sharded")
    runs = max(16, -(-rows.count() // RUN_ROWS))
    placed = rows.withColumn("run", F.pmod(F.xxhash64("at"), F.lit(runs)))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(stage(counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start")), "runs"))
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("at"))
    numbered = placed.withColumn("place", place - 1).join(starts, ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard")
