"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Rows and bytes up to which a materialised side of a join is broadcast. Above either Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own, if there is but one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Ask for a broadcast of a staged table if its counted rows and their bytes are few; else leave the join to a shuffle."""

    def width(field: T.StructField):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(field.name)))
        return F.lit(8)

    bytes_ = sum((F.coalesce(width(f), F.lit(0)) for f in df.schema.fields), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


#: Rows of one key above which it is hot, at least; and the most keys that are.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_each(rows: DataFrame, per_key: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``: one row a key, whose column n tells how many of ``rows`` have it, and drops out.

    Rows of hot keys stay where they are and meet a broadcast of their keys, at most HOT_KEYS; only the others are shuffled, so
    no task gets all rows of a hot key. ``total``: rows at most; if it isn't given, ``per_key`` must be staged, as it is counted.
    Its columns must be of bounded width.
    """
    if total is None:
        total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(per_key.where(F.col("n") > limit).drop("n")), per_key.where(F.col("n") <= limit).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def crc_text(col):
    """Unsigned crc32 of the decimal text of an integer id; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


#: Rows of a batch that goes to a Python worker, where rows hold whole texts.
BATCH_ROWS = 2_000


def short_batches(rows: DataFrame) -> DataFrame:
    """``rows``, for ``mapInArrow`` on whole texts: lets the session send fewer rows at once, as each is large."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return rows


#: Rows that a Python worker looks at together.
SLICE_ROWS = 512


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few of them as Python objects; one empty batch for none."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
