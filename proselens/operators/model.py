"""The linear classifier: fitting, quantising, scoring, calibrating and deciding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as tokens_
from ..functions.features import BITS, fold, hash_features, written_vectors
from ..scratch import materialise

#: Tolerated shares of human texts flagged, and the fewest words that the model judges.
BUDGETS = {"gentle": 0.003, "balanced": 0.01, "strict": 0.03}
LEAST_WORDS = 40


@dataclass
class Model:
    """int8 weights of 2**bits buckets, with what turns them into a probability."""

    weights: np.ndarray
    scale: float
    bias: float
    bits: int = BITS
    thresholds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    trained: str = ""

    def __post_init__(self):
        if len(self.weights) != 1 << self.bits:
            raise ValueError(f"{len(self.weights)} weights; the model's width is 2^{self.bits}")


def balance(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """``df`` with ``weight`` times N / (2 N_class); N are sums of weights."""
    totals = df.groupBy(label).agg(F.sum(weight).alias("__class"))
    everything = totals.agg(F.sum("__class").alias("__all"))
    factors = totals.crossJoin(everything).select(F.col(label).alias("__label"), (F.col("__all") / (2 * F.col("__class"))).alias("__factor"))  # two rows
    return df.join(F.broadcast(factors), F.col(label) == F.col("__label")).withColumn(weight, F.col(weight) * F.col("__factor")).drop("__label", "__factor")


def quantize(coefficients: np.ndarray) -> tuple[np.ndarray, float]:
    """(int8 weights, scale): the largest weight becomes 127; halves go to even."""
    scale = float(np.abs(coefficients).max(initial=0)) / 127 or 1.0
    return np.clip(np.rint(coefficients / scale), -127, 127).astype(np.int8), scale


def quantize_table(weights: DataFrame) -> DataFrame:
    """bucket, q, scale from a table (bucket, weight); scale 1 if all weights are zero."""
    scale = weights.agg(F.coalesce(F.nullif(F.max(F.abs("weight")) / 127, F.lit(0.0)), F.lit(1.0)).alias("scale"))  # one row
    return weights.crossJoin(F.broadcast(scale)).select("bucket", F.greatest(F.least(F.rint(F.col("weight") / F.col("scale")), F.lit(127)), F.lit(-127)).cast("tinyint").alias("q"), "scale")


def fit(df: DataFrame, label: str = "label", weight: str = "weight", c: float = 4.0, bits: int = BITS, text: str = "text", most_steps: int = 100, hashed: str | None = None, width: int | None = None) -> Model:
    """A class-balanced L2 logistic regression on the presence of hashed words, quantised.

    Texts are hashed once and their vectors written; sums of weights read only labels and weights. Each step sums a gradient of
    2**bits numbers over partitions as a tree; the estimator keeps the rows, in blocks, where they are, so nothing else does.
    ``hashed``: a column of buckets, of ``width`` or else of this width or a wider one, which is folded, instead of the text.
    """
    if hashed:
        own = F.col(hashed) if width == bits else fold(hashed, bits)
        buckets = df.where(F.size(hashed) > 0).select(F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"), own.alias("features"))
    else:  # written before rows are dropped: a filter on what a Python function returns would call it twice
        buckets = materialise(df.select(F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"), hash_features(text, bits).alias("features")), "hashed").where(F.size("features") > 0)
    rows = balance(written_vectors(buckets, bits))
    total, human, machine = rows.agg(F.sum("weight"), F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not human or not machine:
        raise ValueError("both classes are needed")
    estimator = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=most_steps, aggregationDepth=2)
    fitted = estimator.fit(rows)
    weights, scale = quantize(fitted.coefficients.toArray())
    return Model(weights, scale, float(fitted.intercept), bits, counts={"human": human, "machine": machine})


def _scored(lists: pa.ListArray, weights: np.ndarray, scale: float, bias: float) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = weights[pc.list_flatten(lists).to_numpy()].astype(np.float64)
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), flat, len(sizes))
    z = bias + sums * scale / np.sqrt(np.maximum(sizes, 1))
    return pa.array(np.where(sizes > 0, 1 / (1 + np.exp(-z)), 0.5))


def probability(features: Column | str, model: Model, spark) -> Column:
    """P(machine-written) of a feature array; 0.5 without features. The weights (2**bits bytes) are broadcast."""
    shared = spark.sparkContext.broadcast((model.weights, model.scale, model.bias))

    @F.arrow_udf("double")
    def scored(lists: pa.Array) -> pa.Array:
        return _scored(lists, *shared.value)

    return scored(F.col(features) if isinstance(features, str) else features)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "p") -> DataFrame:
    return df.withColumn(into, probability(hash_features(text, model.bits), model, df.sparkSession))


#: Fixed value: the text by which a saved model is checked.
PROBE = "It's not just a tool — it's a game-changer. Let's dive in!\nHere's why."


def probe(spark, model: Model, text: str = PROBE) -> dict:
    """text, features and p of one text under a model: what another reader of its weights must find."""
    row = spark.createDataFrame([(text,)], "text string").select(hash_features("text", model.bits).alias("features"))
    found = row.withColumn("p", probability("features", model, spark)).first()
    return {"text": text, "features": list(found["features"]), "p": found["p"]}


def score_by_join(df: DataFrame, weights: DataFrame, scale: float, bias: float, key: str = "doc_id", features: str = "features") -> DataFrame:
    """key, p: the same with joins, for weights in a table (bucket, w)."""
    hit = df.select(key, F.explode_outer(features).alias("bucket")).join(weights, "bucket", "left")
    sums = hit.groupBy(key).agg(F.sum("w").alias("s"), F.count("bucket").alias("n"))
    z = F.lit(bias) + F.coalesce("s", F.lit(0)) * F.lit(scale) / F.sqrt("n")
    return sums.select(key, F.when(F.col("n") == 0, 0.5).otherwise(1 / (1 + F.exp(-z))).alias("p"))


def calibrate(scored: DataFrame, p: str = "p", budgets: dict[str, float] = BUDGETS) -> DataFrame:
    """One row: for each budget the quantile of human scores above which that share lies (linear interpolation).

    Scores are counted by value, and values by range, so that ranks are sums of ranges and of one range's values; no task sees
    all values. Scores lie between 0 and 1.
    """
    by_score = scored.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("p") * 4096).cast("int"))
    ranges = by_score.groupBy("range").agg(F.sum("n").alias("in_range"))  # 4,097 rows at most
    before = F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("range", before.alias("start"), F.sum("in_range").over(Window.partitionBy()).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("within", within).join(F.broadcast(starts), "range").withColumn("first", F.col("start") + F.col("within"))
    place = lambda share: (F.col("total") - 1) * F.lit(1 - share)
    at = lambda k: F.max(F.when(k.between(F.col("first"), F.col("first") + F.col("n") - 1), F.col("p")))
    low = [at(F.floor(place(share))).alias(f"{name}_low") for name, share in budgets.items()]
    high = [at(F.ceil(place(share))).alias(f"{name}_high") for name, share in budgets.items()]
    part = [F.max(place(share) - F.floor(place(share))).alias(f"{name}_part") for name, share in budgets.items()]
    return ranked.agg(*low, *high, *part).select(*[(F.col(f"{k}_low") + F.col(f"{k}_part") * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k in budgets])


def train(fitting: DataFrame, humans: DataFrame, budgets: dict[str, float] = BUDGETS, **options) -> Model:
    """Fit, quantise, and take thresholds from the scores of human texts that weren't fitted."""
    model = fit(fitting, **options)
    # written first: filters on scores would go down to the tables' scans, and hash texts that aren't calibrated on, and each use of scores again
    scores = materialise(score(humans, model).select("p"), "scores")
    model.thresholds = calibrate(scores, budgets=budgets).first().asDict()
    return model


def model_verdict(p: Column, words: Column, thresholds: dict[str, float], sensitivity: str = "balanced", least: int = LEAST_WORDS) -> Column:
    """The model's part: null where it abstains."""
    if sensitivity not in thresholds:
        return F.lit(None).cast("string")
    found = F.when(p >= thresholds[sensitivity], "slop")
    if "strict" in thresholds:
        found = found.when(p >= thresholds["strict"], "suspect")
    return F.when(p.isNotNull() & (words >= least), found.otherwise("clean"))


def decide(tells_verdict: Column, p: Column, words: Column, thresholds: dict[str, float], sensitivity: str = "balanced", least: int = LEAST_WORDS) -> Column:
    """The worse of the model's and the tells' verdicts."""
    model = model_verdict(p, words, thresholds, sensitivity, least)
    worst = lambda v: F.coalesce(model == v, F.lit(False)) | (tells_verdict == v)
    return F.when(worst("slop"), "slop").when(worst("suspect"), "suspect").otherwise("clean")


def compare_bits(train: DataFrame, test: DataFrame, widths: list[int], label: str = "label", weight: str = "weight", text: str = "text", **options) -> DataFrame:
    """Test rows scored by models of several widths, one after the other: the columns of ``test``, bits, p.

    Texts are hashed once, at the largest width, and their buckets kept; every width folds those.
    """
    hashed = hash_features(text, max(widths)).alias("__hashed")
    fitting = materialise(train.select(label, weight, hashed), "hashed")
    judged = materialise(test.select(*test.columns, hashed), "hashed")
    found = None
    for bits in widths:
        model = fit(fitting, bits=bits, label=label, weight=weight, hashed="__hashed", width=max(widths), **options)
        one = judged.withColumn("p", probability(fold("__hashed", bits), model, test.sparkSession)).withColumn("bits", F.lit(bits)).drop("__hashed")
        found = one if found is None else found.unionByName(one)
    return found


def register(spark, model: Model, name: str = "probability") -> None:
    """``name``(text) for SQL: P(machine-written) under a model, which is checked by its probe first; and the functions of ``features.register``.

    The weights are broadcast once and go with the function.
    """
    if not 0 <= probe(spark, model)["p"] <= 1:
        raise ValueError("the model gives no probability")
    tokens_.register(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.scale, model.bias))
    bits = model.bits

    @F.arrow_udf("double")
    def of_tokens(lists: pa.Array) -> pa.Array:
        return _scored(tokens_.buckets(lists, bits), *shared.value)

    spark.udf.register(f"{name}_of_tokens", of_tokens)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS DOUBLE RETURN {name}_of_tokens({tokens_.tokens_sql('t')})")
