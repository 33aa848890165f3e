"""Reading and writing corpora. Every source has an explicit schema."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, count_words, detokenize, strip_html, trim_all
from ..operators.model import Model, probe
from ..operators.provenance import HEAD_BYTES
from ..shipping import ship

TEXTS = "genre string, text string"
RAID_IN = "source_id string, model string, domain string, attack string, generation string"
QA = "question string, human_answers array<string>, chatgpt_answers array<string>, source string"
DUMP = "hits array<struct<comment_text:string,created_at_i:bigint>>"
HELDOUT = "set string, label int, text string"
DAY = 86_400


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One record a line; lines that don't parse give nulls."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType = TEXTS) -> DataFrame:
    """Files that are one array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def raid_rows(df: DataFrame) -> DataFrame:
    """src, domain, model, group, text: rows not attacked, no poetry, of at least 40 words."""
    kept = df.where((F.col("attack") == "none") & (F.col("domain") != "poetry") & (count_words("generation", curly=False) >= 40))
    return kept.select(F.lit("raid").alias("src"), "domain", "model", F.coalesce("source_id", F.lit("")).alias("group"), trim_all(F.col("generation")).alias("text"))


def qa_rows(df: DataFrame, least: int = 25) -> DataFrame:
    """question, text, source, label (0 human, 1 machine): an answer a row, of at least ``least`` words."""

    def side(column: str, label: int, clean) -> DataFrame:
        rows = df.select("question", F.explode(column).alias("text"), "source").where(count_words("text", curly=False) >= least)
        return rows.select(F.coalesce("question", F.lit("")).alias("question"), clean(F.col("text")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.lit(label).alias("label"))

    return side("human_answers", 0, detokenize).unionByName(side("chatgpt_answers", 1, trim_all))


def in_windows(seconds: Column, start: int, stride_days: int, n_days: int) -> Column:
    """Whether a time is strictly inside one of ``n_days`` days that begin ``stride_days`` apart."""
    since = seconds - F.lit(start)
    within = F.pmod(since, F.lit(stride_days * DAY))
    return (since > 0) & (since < F.lit(n_days * stride_days * DAY)) & (within > 0) & (within < DAY)


def comment_rows(df: DataFrame, start: int, stride_days: int, n_days: int, low: int, high: int) -> DataFrame:
    """text: comments of the day windows, without markup, of ``low`` to ``high`` words."""
    rows = df.select(F.explode("hits").alias("hit")).where(in_windows(F.col("hit.created_at_i"), start, stride_days, n_days))
    texts = rows.select(strip_html(F.coalesce("hit.comment_text", F.lit(""))).alias("text"))
    return texts.where(count_words("text", curly=False).between(low, high))


#: Marks around a book's body, and what no paragraph of prose holds.
BOOK_START, BOOK_END = "*** START OF", "*** END OF"
BOOK_JUNK = r"[_*]{2}|CHAPTER|Gutenberg"


def book_paragraphs(df: DataFrame, key: str = "title", text: str = "text") -> DataFrame:
    """title, para_no, text: paragraphs of 60 to 400 words between the marks, or of the whole text without them."""
    whole = F.col(text)
    a, b = F.instr(whole, BOOK_START), F.instr(whole, BOOK_END)
    begin = F.expr(f"locate('\n', `{text}`, instr(`{text}`, '{BOOK_START}'))")
    body = F.when((a > 1) & (b > a), F.substring(whole, begin, b - begin)).otherwise(whole)
    rows = df.select(key, F.posexplode(F.split(body, rf"\r?\n{WS}*\r?\n")).alias("para_no", "text"))
    clean = rows.withColumn("text", trim_all(F.regexp_replace("text", rf"{WS}+", " ")))
    return clean.where(count_words("text", curly=False).between(60, 400) & ~F.col("text").rlike(BOOK_JUNK))


#: Kinds of stores that parts of files can be read from without Spark's whole-file reader.
RANGED = {"file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss"}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path within it of a file as Spark names it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest)}")


def head(store: fs.FileSystem, path: str, most: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file; no more are asked for."""
    with store.open_input_file(path) as f:
        return f.read(most)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # so many heads are held at once
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column("path"), pa.array([head(*_store(uri)) for uri in part.column("path").to_pylist()], pa.binary())], names=["path", "content"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content: the first 192 KiB of each file.

    Files are listed by Spark, which opens none for their names; tasks then read the heads, by ranges, where the kind of store
    allows it (RANGED). Files of other stores are read whole and cut. Empty files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() not in RANGED:
        return files.select("path", F.substring("content", 1, HEAD_BYTES).alias("content"))
    ship(spark)
    return files.select("path").mapInArrow(_heads, "path string, content binary")


def write_heldout(df: DataFrame, path: str, form: str = "json") -> None:
    """A folder for each set."""
    df.select("set", "label", "text").write.mode("overwrite").partitionBy("set").format(form).save(path)


def read_heldout(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return spark.read.schema(HELDOUT).format(form).load(path).select("set", "label", "text")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """weights (bucket, w) as Parquet, and one row of everything else as JSON."""
    buckets = spark.range(0, len(model.weights), 1, 4)
    packed = spark.createDataFrame([(bytearray(model.weights.tobytes()),)], "packed binary")  # 2**bits bytes
    byte = F.conv(F.hex(F.substring(F.col("packed"), (F.col("id") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    buckets.crossJoin(F.broadcast(packed)).select(F.col("id").cast("int").alias("bucket"), F.when(byte > 127, byte - 256).otherwise(byte).cast("tinyint").alias("w")).write.mode("overwrite").parquet(f"{path}/weights")
    meta = {"version": 1, "bits": model.bits, "scale": model.scale, "bias": model.bias, "thresholds": model.thresholds, "trained": model.trained, "data": model.counts, "probe": probe(spark, model)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Model:
    """Fails if there are not 2**bits weights, or if the probe's features or score aren't those of the saved model."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    rows = spark.read.schema("bucket int, w tinyint").parquet(f"{path}/weights").toPandas()  # 2**bits rows
    weights = np.zeros(len(rows), np.int8)
    if len(rows) == 1 << meta["bits"]:
        weights[rows["bucket"]] = rows["w"]
    model = Model(weights, meta["scale"], meta["bias"], meta["bits"], meta["thresholds"], meta["data"], meta.get("trained", ""))
    if told := meta.get("probe"):
        own = probe(spark, model, told["text"])
        if own["features"] != told["features"] or abs(own["p"] - told["p"]) > 1e-6:
            raise ValueError("the model's probe doesn't hold: its tokens, hashes or weights differ from those it was saved with")
    return model


def source_counts(df: DataFrame, source: str = "src") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"))


def write_corpus(df: DataFrame, path: str, form: str = "parquet", source: str = "src") -> DataFrame:
    """Write a corpus; returns the rows of each source as written."""
    df.write.mode("overwrite").format(form).save(path)
    return source_counts(df.sparkSession.read.schema(df.schema).format(form).load(path), source)
