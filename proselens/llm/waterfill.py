"""Mixing sources to target weights by capped water-filling.

Targets share a number of words by weight; a source stops at ``max_epochs`` times its words and the excess goes to the others
by weight until none is above. That fixed point is the waterline: sources are ordered by how soon they fill up, and running
sums tell which are full. A source's target is then taken as whole repetitions of all its documents, and one more of a
seeded draw of them that together hold the fraction left.

The draw orders a source's documents by hash and takes them up to the wanted words. Hash ranges (bins) are summed first;
bins wholly below the cut are taken, bins above are not, and only the bin at the cut is put in order, so no source, however
large, is sorted in one task.

Rows: a null text has size 0 and is taken 0 times. A null source is a source of its own, last in order. Rows are
drawn apart, those of one id in the order of their texts' hashes; of rows equal in id, text and source as many are drawn as bring
the source nearest to its target. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stage

#: Hash ranges that a source's draw is summed in, and parts that equal documents at a cut are numbered in.
BINS, PARTS = 4096, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, max_epochs: float, weights: Column | None = None) -> DataFrame:
    """sizes: source, source_size, one row a source. Adds weight and target.

    ``weights``: of a source, by default 3, 1, 2 and so on in the order of sources. The table has a row for each source, so
    its running sums are cheap.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("weight", weights if weights is not None else F.element_at(F.array(*[F.lit(float(x)) for x in (3, 1, 2)]), ((order - 1) % 3 + 1).cast("int")))
    capped = weighted.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = capped.withColumns({
        "budget": F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)),
        "cap_before": F.coalesce(F.sum("cap").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(soonest.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the waterline if this source is the first that isn't full
    line = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    levels = full.withColumn("line", F.when(line * F.col("weight") < F.col("cap"), line))
    level = F.first("line", ignorenulls=True).over(soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = levels.withColumn("level", level)
    return filled.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _ticket(seed: int) -> Column:
    """A document's place in the draw, in [0, 2**63): md5, so that any engine can draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _with_ticket(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, text_hash, size, ticket and bin, under names that no table has."""
    return docs.withColumns({"__id": F.col("doc_id"), "__source": F.col("source"), "__hash": F.xxhash64("text"), "__size": word_count(F.col("text")), "__ticket": _ticket(seed)}).withColumn(
        "__bin", F.shiftright("__ticket", 48).cast("int")
    )


_ME = ("__ticket", "__id", "__hash", "__size")


def plan(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """One row a source: source, source_size, target, whole (repetitions of every document), and where its draw ends (edge, last)."""
    rows = stage(_with_ticket(docs, seed).select("__source", "__bin", *_ME), "sizes")
    binned = stage(rows.groupBy("__source", "__bin").agg(F.sum("__size").alias("words")), "bins")
    sizes = binned.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = targets(sizes, share, max_epochs).withColumn("whole", F.floor(epochs).cast("int"))
    aimed = small(stage(aimed.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")), "targets"))
    before = F.sum("words").over(Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    running = binned.withColumn("before", F.coalesce(before, F.lit(0))).join(aimed, F.col("__source").eqNullSafe(F.col("source")))
    edge = running.where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted")))
    edge = small(stage(edge.select(F.col("source").alias("s"), F.col("__bin").alias("edge"), "before", "wanted"), "edges"))
    # documents of the bin at the cut, equal ones as one with their number, in order, up to the words that come nearest
    cut = rows.join(edge, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__bin") == F.col("edge")))
    places = cut.groupBy("s", "edge", "before", "wanted", *_ME).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("s", "edge").orderBy(*_ME).rowsBetween(Window.unboundedPreceding, 0)
    ahead = places.withColumn("ahead", F.col("before") + F.sum(F.col("__size") * F.col("copies")).over(order) - F.col("__size") * F.col("copies"))
    one = (F.col("ahead") + F.col("__size") - F.col("__size") / 2 <= F.col("wanted")).cast("long")
    some = F.least(F.col("copies"), F.greatest(F.lit(0), F.floor((F.col("wanted") - F.col("ahead")) / F.col("__size") + 0.5)))
    drawn = ahead.withColumn("drawn", F.when((F.col("copies") == 1) | (F.col("__size") == 0), one * F.col("copies")).otherwise(some)).where("drawn > 0")
    last = drawn.groupBy(F.col("s").alias("z")).agg(F.max(F.struct(F.struct(*_ME).alias("place"), (F.col("copies") - F.col("drawn")).alias("spare"))).alias("x"))
    ends = edge.select("s", "edge").join(last.select("z", F.col("x.place").alias("last"), F.col("x.spare").alias("spare")), F.col("s").eqNullSafe(F.col("z")), "left").select("s", "edge", "last", "spare")
    ends = aimed.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return small(stage(ends.select("source", "source_size", "target", "whole", "edge", "last", "spare"), "plan"))


def apply_plan(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __times (how often the mix takes the document). One pass, no shuffle.

    Only if a draw ends among equal documents are those numbered, in PARTS of their own, so that not all of them are taken.
    """
    own = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in plan.columns])
    placed = _with_ticket(docs, seed).join(own, F.col("__source").eqNullSafe(F.col("__plan_source")))
    edge, place = F.col("__plan_edge"), F.struct(*_ME)
    extra = F.when(edge.isNull(), False).when(F.col("__bin") != edge, F.col("__bin") < edge).otherwise(F.coalesce(place <= F.col("__plan_last"), F.lit(False)))
    kept = [*docs.columns, "__size", F.col("__plan_source_size").alias("__source_size"), F.col("__plan_target").alias("__target")]
    times = lambda one_more: (F.col("__plan_whole") + one_more.cast("int")).alias("__times")
    if plan.where("spare > 0").isEmpty():
        return placed.select(*kept, times(extra))
    tied = F.coalesce((F.col("__plan_spare") > 0) & (F.col("__bin") == edge) & (place == F.col("__plan_last")), F.lit(False))
    same = stage(placed.where(tied).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "tied")
    parts = same.groupBy(F.col("__plan_source").alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy("__s").orderBy("__p")) - F.col("__n")
    numbered = same.join(small(stage(parts.select("__s", "__p", ahead.alias("__ahead")), "parts")), F.col("__plan_source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    number = F.row_number().over(Window.partitionBy("__plan_source", "__part").orderBy(F.lit(0))) + F.col("__ahead")
    numbered = numbered.withColumn("__number", number)
    return placed.where(~tied).select(*kept, times(extra)).unionByName(numbered.select(*kept, times(F.col("__number") > F.col("__plan_spare"))))


def repeat(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: each document as many times as drawn, with its columns."""
    taken = apply_plan(docs, plan(docs, share, max_epochs, seed), seed)
    return taken.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def result(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = docs.select("doc_id", "text", "source")
    taken = (F.col("__times") * F.col("__size")).alias("taken")
    return apply_plan(rows, plan(rows)).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ticket
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0, 1.0, 2.0], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, least(1.5::DOUBLE * sum(source_size) OVER (), sum(cap) OVER ()) AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w),
l AS (SELECT first((budget - cap_before) / weight_left ORDER BY cap / weight, source NULLS LAST) FILTER ((budget - cap_before) / weight_left * weight < cap) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS wanted,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ticket, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN wanted > 0 AND upto - size / 2.0 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
