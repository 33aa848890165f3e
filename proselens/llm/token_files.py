"""Token ids in Parquet: list columns laid out for selective reads.

A written corpus is a folder with ``tokens`` (one row per document, in ascending document order over all files) and ``parts``
(one row per file group: rows, tokens, and the number of tokens before it). In ``tokens`` the ids are a dictionary-encoded
list column; document ids, lengths and offsets are delta-encoded; row groups and pages are small enough that column and page
indexes let a reader skip to a few documents, and metadata can be read without touching the ids.

Rows: a null text counts as empty (only the end id). A null id sorts first. Repeated ids stay, ordered by a hash of their text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, byte_level
from .shared import new_path

#: Texts encoded at once, in bytes; with the chunks remembered this bounds a worker's memory.
SLICE = 6_000_000


@dataclass(frozen=True)
class Layout:
    """How the files are laid out."""

    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    dictionary_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_bytes),
            "parquet.enable.dictionary": "false",  # whole numbers then get delta encoding
            "parquet.enable.dictionary#ids.list.element": "true",
        }


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts (strings without nulls) of about ``most`` bytes together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    a = done = 0
    while a < len(texts):
        b = min(len(texts), int(np.searchsorted(ends, done + most)) + 1)
        yield a, b
        a, done = b, int(ends[b - 1])


@lru_cache(maxsize=2)
def _byte_level_encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return byte_level(model, lambda chunks: model.encode_batch_fast(chunks, add_special_tokens=False))


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _byte_level_encoder(path), 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in slices(texts):
                ids, sizes = encoder(texts[a:b])
                bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
                flat = np.full(bounds[-1], end_id, np.int32)
                own = np.ones(len(flat), bool)
                own[bounds[1:] - 1] = False
                flat[own] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[a:b],
                        batch.column("part")[a:b],
                        pa.array(before + bounds[:-1]),
                        pa.array(sizes + 1),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)),
                    ],
                    schema=schema,
                )
                before += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, layout: Layout = Layout(), partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the corpus to ``path``.

    One shuffle deals documents by ranges of doc_id; each task encodes its run in order, so its offsets are running sums.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    order = ["doc_id", "hash"]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    encoded = dealt.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), "doc_id long, part int, offset long, n_tokens long, ids array<int>")
    encoded.write.options(**layout.options()).parquet(f"{path}/tokens")
    by_part = read_metadata(docs.sparkSession, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file group
    by_part.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


TOKENS = "doc_id long, part int, offset long, n_tokens long, ids array<int>"
PARTS = "part int, n_docs long, n_tokens long, before long"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the ids; the ids' column chunks are not read."""
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens").select("doc_id", "part", "offset", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids. Filters on doc_id reach the column indexes."""
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "before")
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    return tokens.join(parts, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, bounds = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: crc32 of a document's ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to new token files in the shared folder and digest what they hold."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path)
    return digests(read_tokens(spark, path))
