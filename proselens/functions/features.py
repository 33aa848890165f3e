"""Tokens and hashed word features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import new_folder
from ..shipping import ship
from .patterns import WS
from .text import model_prep

BITS = 17
MOST_TOKENS = 600
#: What counts as an emoji, and as a token.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?|[—–!?;:,.()\"…¶]|" + EMOJI


def tokens(text: Column | str, most: int = MOST_TOKENS) -> Column:
    """The first words, punctuation marks and emoji (all alike: EMO) of a text."""
    found = F.slice(F.regexp_extract_all(model_prep(text), F.lit(TOKEN), F.lit(0)), 1, most)
    return F.transform(found, lambda t: F.when(t.rlike(EMOJI), F.lit("EMO")).otherwise(t))


def _run_on(state: np.ndarray, words: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """32-bit FNV-1a carried on from ``state`` over the UTF-8 bytes of words (or of those at ``at``): one step a byte position for all."""
    begin, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    begin, sizes = begin[:-1], np.diff(begin)
    if at is not None:
        begin, sizes = begin[at], sizes[at]
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, hashes = begin[order], sizes[order], np.broadcast_to(state, len(order)).astype(np.uint64)[order]
    left = len(order)
    for k in range(int(sizes.max(initial=0))):
        left = int(np.searchsorted(-sizes[:left], -k, side="left"))  # those longer than k
        hashes[:left] = ((hashes[:left] ^ data[begin[:left] + k]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _of(text: str) -> np.uint64:
    return _run_on(np.uint64(0x811C9DC5), pa.array([text]))[0]


def fnv1a(strings: list[str]) -> np.ndarray:
    """32-bit FNV-1a over UTF-8, for many strings at once."""
    return _run_on(np.uint64(0x811C9DC5), pa.array(strings, pa.string()))


@F.pandas_udf(T.LongType())
def fnv1a32(text: pd.Series) -> pd.Series:
    """FNV-1a of each string; each distinct one of a batch is hashed once."""
    codes, kinds = pd.factorize(text)
    found = pd.Series(fnv1a(list(kinds)).astype("int64"), dtype="Int64").take(codes.clip(min=0)).reset_index(drop=True) if len(kinds) else pd.Series([pd.NA] * len(text), dtype="Int64")
    return found.mask(pd.Series(codes) < 0)


def buckets(lists: pa.ListArray, bits: int) -> pa.ListArray:
    """Buckets of each list's tokens and of its pairs of neighbours. Each distinct token, and each distinct pair, is hashed once."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    coded = pc.list_flatten(lists).cast(pa.string()).dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(sizes)), sizes)
    paired = np.flatnonzero(row[1:] == row[:-1])  # tokens with a neighbour after them
    pairs = pa.array(codes[paired] * len(words) + codes[paired + 1]).dictionary_encode()
    which = pairs.indices.to_numpy()
    first, second = np.divmod(pairs.dictionary.to_numpy(), max(1, len(words)))
    space = ((_run_on(_of("b"), words) ^ np.uint64(0x20)) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    mask = np.uint64((1 << bits) - 1)
    single, double = _run_on(_of("u"), words) & mask, _run_on(space[first], words, second) & mask
    keys = np.unique(np.concatenate((row << bits | single.astype(np.int64)[codes], row[paired] << bits | double.astype(np.int64)[which])))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(keys >> bits, minlength=len(sizes)))))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys & ((1 << bits) - 1), pa.int32()))


def hash_features(text: Column | str, bits: int = BITS) -> Column:
    """Sorted distinct buckets of the words and word pairs of a text."""

    @F.arrow_udf("array<int>")
    def hashed(lists: pa.Array) -> pa.Array:
        return buckets(lists, bits)

    return hashed(tokens(text))


def fold(features: Column | str, bits: int) -> Column:
    """The buckets at a smaller width: those of a wider hash by their low bits, as a hash of that width gives them."""
    wide = F.col(features) if isinstance(features, str) else features
    return F.array_sort(F.array_distinct(F.transform(wide, lambda b: b.bitwiseAND(F.lit((1 << bits) - 1)))))


def to_vectors(df: DataFrame, bits: int = BITS, features: str = "features", vector: str = "vector") -> DataFrame:
    """``df`` with a sparse vector of size 2**bits: 1 / sqrt(n) at each of its n buckets."""
    words = df.withColumn("__words", F.transform(features, lambda b: b.cast("string")))
    # one call makes the vocabulary in the JVM; ``from_vocabulary`` makes one call a word
    vocabulary = df.sparkSession._jvm.org.apache.commons.lang3.StringUtils.split(",".join(map(str, range(1 << bits))), ",")
    counter = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", vocabulary)
    counter.setInputCol("__words").setOutputCol("__counts").setBinary(True).setMinTF(1.0)
    return Normalizer(p=2.0, inputCol="__counts", outputCol=vector).transform(counter.transform(words)).drop("__words", "__counts")


def written_vectors(df: DataFrame, bits: int = BITS, features: str = "features", vector: str = "vector") -> DataFrame:
    """``to_vectors`` by way of a table, for many rows: the columns that make a sparse vector are written, and read back as vectors."""
    own = F.coalesce(features, F.array().cast("array<int>"))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(1 << bits).alias("size"), own.alias("indices"), F.array_repeat(F.try_divide(F.lit(1.0), F.sqrt(F.size(own))), F.size(own)).alias("values"))
    path = new_folder(df.sparkSession, "vectors")
    df.withColumn(vector, parts).drop(features).write.parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name != features]).add(vector, VectorUDT())
    return df.sparkSession.read.schema(schema).parquet(path)


#: ``tokens`` as SQL.
_TOKENS_SQL = """transform(slice(regexp_extract_all(regexp_replace(regexp_replace(lower(translate(coalesce({text}, ''), '‘’ʼ“”' || char(160), {quotes})), '[0-9]+', '0'), {newlines}, ' ¶ '), {token}, 0), 1, {most}),
  t -> CASE WHEN t RLIKE {emoji} THEN 'EMO' ELSE t END)"""


def tokens_sql(text: str) -> str:
    """A SQL expression with the value of ``tokens``."""
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return _TOKENS_SQL.format(text=text, quotes=q("'''\"\" "), newlines=q(rf"{WS}*\n+{WS}*"), token=q(TOKEN), most=MOST_TOKENS, emoji=q(EMOJI))


def register(spark: SparkSession) -> None:
    """For SQL: fnv1a32(text), hash_tokens(tokens) and hash_features(text) at the default width."""
    ship(spark).udf.register("fnv1a32", fnv1a32)

    @F.arrow_udf("array<int>")
    def of_tokens(lists: pa.Array) -> pa.Array:
        return buckets(lists, BITS)

    spark.udf.register("hash_tokens", of_tokens)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hash_features(t STRING) RETURNS ARRAY<INT> RETURN hash_tokens({tokens_sql('t')})")
