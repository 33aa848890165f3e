"""How many texts are flagged, and how well scores rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import LEAST_WORDS


def _share(hit: Column) -> Column:
    return F.avg(F.when(hit, 100.0).otherwise(0.0))


def flagged_by_set(df: DataFrame, verdicts: dict[str, str], group: str = "set") -> DataFrame:
    """set, n, and for each sensitivity the percentage with verdict slop. ``verdicts``: sensitivity -> column."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[_share(F.col(column) == "slop").alias(name) for name, column in verdicts.items()])


def model_only_by_set(df: DataFrame, thresholds: dict[str, float], group: str = "set", p: str = "p", words: str = "words") -> DataFrame:
    """set, n, and for each threshold the percentage that the model alone flags."""
    enough = F.col(words) >= LEAST_WORDS
    return df.groupBy(group).agg(F.count("*").alias("n"), *[_share(enough & (F.col(p) >= t)).alias(name) for name, t in thresholds.items()])


def auc(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """One row, auc: the chance that a machine text scores above a human one, ties half; null where a class is absent.

    Rows are first counted by score; running sums are made within ranges of scores and added up, so no task sees all scores.
    """
    by_score = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("m"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("h"))
    ranged = by_score.withColumn("range", F.floor(F.col("p") * 4096).cast("int"))
    totals = ranged.groupBy("range").agg(F.sum("h").alias("t"))
    below_range = F.coalesce(F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("range", below_range.alias("start"))  # 4,097 rows at most
    within = F.coalesce(F.sum("h").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("within", within).join(F.broadcast(starts), "range")
    won = F.sum(F.col("m") * (2 * (F.col("start") + F.col("within")) + F.col("h")))
    return ranked.agg(F.try_divide(won, 2 * F.sum("m") * F.sum("h")).alias("auc"))


#: Characters of a text that are shown beside a miss, and beside a wrong flag.
MISS_CHARS, FLAG_CHARS = 110, 140


def _shown(df: DataFrame, chars: int, text: str, tells: str) -> DataFrame:
    """``df`` with why: the labels of its tells, heaviest first; and excerpt: how the text begins, on one line."""
    why = F.array_join(F.transform(tells, lambda t: t["label"]), " · ")
    return df.withColumns({"why": F.coalesce(why, F.lit("")), "excerpt": F.translate(F.substring(text, 1, chars), "\n", " ")})


def misses(df: DataFrame, families: str, group: str = "set", verdict: str = "verdict", label: str = "label", text: str = "text", tells: str = "tells") -> DataFrame:
    """Machine texts of sets whose names match that aren't flagged, with why and excerpt."""
    return _shown(df.where((F.col(label) == 1) & F.col(group).rlike(families) & (F.col(verdict) != "slop")), MISS_CHARS, text, tells)


def wrong_flags(df: DataFrame, verdict: str = "verdict", label: str = "label", text: str = "text", tells: str = "tells") -> DataFrame:
    """Human texts that are flagged, with why and excerpt."""
    return _shown(df.where((F.col(label) == 0) & (F.col(verdict) == "slop")), FLAG_CHARS, text, tells)


def corpus_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n."""
    return df.groupBy(label).agg(F.count("*").alias("n"))
