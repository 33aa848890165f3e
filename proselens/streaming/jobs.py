"""Jobs on streams of blocks and of edits. State is bounded by watermarks, which are parameters."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tells import analyze, draft_tells
from ..operators.pages import badge, page_counts


def score_blocks(blocks: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """Newly arrived blocks with their analysis; keeps no state."""
    return analyze(blocks, sensitivity=sensitivity)


def changed_blocks(blocks: DataFrame, delay: str = "1 hour", time: str = "ts", key: str = "block_id") -> DataFrame:
    """Blocks once for each text length seen within ``delay``."""
    return blocks.withColumn("length", F.length("text")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key, "length"])


class _InOrder(StatefulProcessor):
    """Arrivals of many blocks (a slot of them) put in order of time. They wait in buckets of time until no earlier row can come any more.

    State is read and written by the bucket, packed, and not by the row: a call to it costs far more than a row does.
    """

    def __init__(self, bucket_ms: int, keep_ms: int):
        self.bucket_ms, self.keep_ms = bucket_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def _wait(self, fresh: list[pd.DataFrame], known: set[int]) -> None:
        rows = pd.concat(fresh)
        for bucket, more in rows.groupby(rows["us"] // (self.bucket_ms * 1000)):
            if bucket in known:
                more = pd.concat([_unpacked(self.waiting.getValue((bucket,))[0]), more])
            self.waiting.updateValue((bucket,), (_packed(more.drop_duplicates()),))
            known.add(bucket)

    def _wake(self, bucket: int | None, last: pd.DataFrame) -> None:
        """One timer a slot: the end of its first bucket, or the time when the last arrivals may go."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if bucket is not None:
            self.handle.registerTimer((bucket + 1) * self.bucket_ms)
        elif len(last):
            self.handle.registerTimer(int(last["us"].max()) // 1000 + self.keep_ms + self.bucket_ms + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, known = [], {b for (b,) in self.waiting.keys()}
        for some in rows:
            fresh.append(some[["block", "us", "length"]])
            if sum(map(len, fresh)) >= HELD_ROWS:
                self._wait(fresh, known)
                fresh = []
        if fresh:
            self._wait(fresh, known)
        self._wake(min(known), _NONE)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        buckets = sorted(b for (b,) in self.waiting.keys())
        due = [b for b in buckets if (b + 1) * self.bucket_ms <= now]
        last = _unpacked(self.last.get()[0]) if self.last.exists() else _NONE
        run: list[pd.DataFrame] = []
        for n, bucket in enumerate(due, 1):
            run.append(_unpacked(self.waiting.getValue((bucket,))[0]))
            self.waiting.removeKey((bucket,))
            if n == len(due) or sum(map(len, run)) >= HELD_ROWS:
                found, last = _changed(last, pd.concat(run), self.keep_ms * 1000)
                yield found
                run = []
        last = last[last["us"] // 1000 + self.keep_ms + self.bucket_ms >= now]  # what waits is of the bucket of ``now`` or later
        if len(last):
            self.last.update((_packed(last),))
        else:
            self.last.clear()
        self._wake(buckets[len(due)] if len(due) < len(buckets) else None, last)


_NONE = pd.DataFrame({"block": pd.Series(dtype=object), "us": pd.Series(dtype="int64"), "length": pd.Series(dtype="int64")})


def _packed(rows: pd.DataFrame) -> bytes:
    return pickle.dumps((rows["block"].tolist(), rows["us"].to_numpy(), rows["length"].to_numpy()), 5)


def _unpacked(packed: bytes) -> pd.DataFrame:
    block, us, length = pickle.loads(packed)
    return pd.DataFrame({"block": pd.Series(block, dtype=object), "us": us, "length": length})


def _changed(last: pd.DataFrame, rows: pd.DataFrame, keep_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of ``rows`` those whose length isn't that of the block's row before; and each block's last row. ``last``: a row a block, before all of ``rows``."""
    both = pd.concat([last.assign(old=True), rows.assign(old=False)], ignore_index=True)
    both["code"] = pd.factorize(both["block"], use_na_sentinel=False)[0]
    both = both.sort_values(["code", "us", "length"], ignore_index=True)
    code, us, length = (both[c].to_numpy() for c in ("code", "us", "length"))
    new = np.ones(len(both), bool)
    new[1:] = (code[1:] != code[:-1]) | (length[1:] != length[:-1]) | (us[1:] - us[:-1] > keep_us)
    end = np.ones(len(both), bool)
    end[:-1] = code[1:] != code[:-1]
    columns = ["block", "us", "length"]
    return both.loc[new & ~both["old"].to_numpy(bool), columns], both.loc[end, columns]


#: The state store that keeps timers and maps of keys; ``transformWithState`` needs it when a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Rows that a task holds before it puts them into its state.
HELD_ROWS = 50_000


def rescored_blocks(blocks: DataFrame, delay: str = "1 hour", keep_ms: int = 3_600_000, bucket_ms: int = 600_000, key: str = "block_id", slots: int = 128) -> DataFrame:
    """key, ts, length: arrivals whose length differs from that of the arrival before, in order of time (then of length), whatever batch they came in.

    Rows up to ``delay`` late find their place; an arrival is given once the watermark has passed the bucket of ``bucket_ms`` that
    it is in. An arrival more than ``keep_ms`` after the one before counts as new, and state goes when it is that old. Blocks are dealt
    over ``slots``, each of which has its state and is one task's at a time; a task holds one bucket of one slot, or ``HELD_ROWS`` if
    that is more. Keys are numbers, dates or strings. The stream must be started with the settings ``STORE``.
    """
    rows = blocks.select(key, "ts", F.length("text").cast("long").alias("length")).where("length IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    # as strings, which pandas holds as they are, nulls included
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"), F.col(key).cast("string").alias("block"), "ts", F.unix_micros("ts").alias("us"), "length")
    found = rows.groupBy("slot").transformWithStateInPandas(_InOrder(bucket_ms, keep_ms), "block string, us long, length long", "Append", "EventTime")
    return found.select(F.col("block").cast(blocks.schema[key].dataType).alias(key), F.timestamp_micros("us").alias("ts"), "length")


def latest_drafts(edits: DataFrame, gap: str = "300 milliseconds", delay: str = "10 seconds", key: str = "draft_id") -> DataFrame:
    """Of each burst of edits (ts, text) the last text, with its tells."""
    bursts = edits.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("burst")).agg(F.max_by("text", "ts").alias("text"))
    return draft_tells(bursts.select(key, F.col("burst.start").alias("start"), "text"))


def running_counts(units: DataFrame) -> DataFrame:
    """page_id, n, badge of append-only units (page_id, verdict); for update mode."""
    return page_counts(units)


class _Changes(StatefulProcessor):
    """What a block adds to its page's count, or takes back: its last verdict is kept, and only a change of it is given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, verdict string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for row in rows:
            # the latest counts; of verdicts of one time the first by name
            if now is None or (-row.us, row.verdict) < (-now[0], now[1]):
                now = row.us, row.verdict
        if now is not None and now != before:
            self.last.update(now)
            change = (now[1] == "slop") - (before is not None and before[1] == "slop")
            if change or before is None:
                yield Row(page_id=key[0], change=change)


def count_changes(scored: DataFrame) -> DataFrame:
    """page_id, change: +1 and -1 as blocks (page_id, block_id, ts, verdict) become slop and cease to be; 0 when a block is first seen and isn't.

    State is one small row a block. The stream must be started with the settings ``STORE``.
    """
    rows = scored.select("page_id", "block_id", F.unix_micros("ts").alias("us"), F.coalesce("verdict", F.lit("clean")).alias("verdict")).where("us IS NOT NULL")
    kind = scored.schema["page_id"].dataType.simpleString()
    return rows.groupBy("page_id", "block_id").transformWithState(_Changes(), f"page_id {kind}, change long", "Append", "None")


def add_changes(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch of changes to the pages' counts, of which ``path`` keeps one version a batch; a retried batch replaces its own.

    A batch reads the last version (a row a page) and its changes, and no blocks.
    """

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        before = [n for n in versions(s, path) if n < number]
        counts = batch.select("page_id", F.col("change").alias("n"))
        if before:
            counts = counts.unionByName(s.read.schema(counts.schema).parquet(f"{path}/batch={before[-1]}"))
        counts.groupBy("page_id").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose counts are complete, in order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [x.getPath() for x in fs.listStatus(folder)]
    return sorted(int(x.getName().partition("=")[2]) for x in found if x.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def current_counts(spark: SparkSession, path: str, schema: str = "page_id string, n long") -> DataFrame:
    """page_id, n, badge after the last batch."""
    known = versions(spark, path)
    counts = spark.read.schema(schema).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], schema)
    return counts.select("page_id", "n", badge(F.col("n")).alias("badge"))
