"""Queries for the streaming jobs: tables arrive as file streams, run until all is read, and results are read from the sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, table
from ..streaming import jobs
from . import sql as S
from .text_queries import planted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _arriving(rows: DataFrame, name: str, at_once: bool = False) -> DataFrame:
    """``rows`` as a stream of files: four, or as many as the rows were read from; in several batches or in one."""
    files, path = max(4, len(rows.inputFiles())), new_folder(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    return _stream(rows, path, None if at_once else files // 2)


def _stream(rows: DataFrame, path: str, per_batch: int | None = 2) -> DataFrame:
    stream = rows.sparkSession.readStream.schema(rows.schema)
    return (stream.option("maxFilesPerTrigger", per_batch) if per_batch else stream).parquet(path)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that a stream needs when it starts; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _drained(stream: DataFrame, name: str, then: Callable[[], None] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Run to the end of the input, again after ``then`` has added to it; what the sink then holds."""
    s, path = stream.sparkSession, new_folder(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append")
    with _settings(s, settings or {}):
        writer.start().awaitTermination()
        if then is not None:
            then()
            writer.start().awaitTermination()
    return s.read.schema(stream.schema).parquet(path)


def score_blocks(s: SparkSession, d: str) -> DataFrame:
    scored = jobs.score_blocks(_arriving(planted(s, d), "blocks"))
    return _drained(scored.select("doc_id", "analysis.density", "analysis.verdict"), "scored")


def _edits(s: SparkSession, d: str) -> DataFrame:
    """Events as arrivals of a user's text, as long as the event's number of the hour."""
    events = table(s, d, "events")
    return events.select(F.col("user_id").alias("block_id"), F.col("ts").cast("timestamp").alias("ts"), F.repeat(F.lit("x"), F.hour(F.col("ts").cast("timestamp")) + 1).alias("text"))


def changed_blocks(s: SparkSession, d: str) -> DataFrame:
    stream = jobs.changed_blocks(_arriving(_edits(s, d), "changed"), "3650 days")
    return _drained(stream.select("block_id", "length"), "changed-out")


#: Arrivals of a block further apart than this don't know of each other; how late one may come.
KEEP_MS, LATE = 6 * 3_600_000, "2 hours"


def rescored_blocks(s: SparkSession, d: str) -> DataFrame:
    """Events in four batches in order of arrival, a third of them 90 minutes late; the end of the stream follows."""
    edits = _edits(s, d)
    arrival = F.unix_seconds("ts") + F.when(F.pmod(F.hash("block_id", "ts"), F.lit(3)) == 0, 5400).otherwise(0)
    at = edits.withColumn("__at", arrival)
    cuts, path = at.approxQuantile("__at", [0.25, 0.5, 0.75], 0.01), new_folder(s, "rescored")
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):  # one after the other: a stream reads files in the order of their times
        at.where((F.col("__at") > low) & (F.col("__at") <= high)).drop("__at").coalesce(4).write.mode("append").parquet(path)
    end = s.createDataFrame([(-1, "2100-01-01 00:00:00", "the end")], "block_id long, ts string, text string").select(F.col("block_id").cast(edits.schema["block_id"].dataType).alias("block_id"), F.col("ts").cast("timestamp").alias("ts"), "text")
    stream = jobs.rescored_blocks(_stream(edits, path, 4), LATE, KEEP_MS, 3_600_000)
    return _drained(stream, "rescored-out", lambda: end.write.mode("append").parquet(path), jobs.STORE).where("block_id >= 0")


TOLD = "We delve into the tapestry of this robust and vibrant realm, and it is a testament to progress for all."
PLAIN = "We met at noon and talked for an hour about the plan, and then all of us went home by train."


def latest_drafts(s: SparkSession, d: str) -> DataFrame:
    """Seven events each as edits of a draft, in a burst of three and, five seconds later, one of four; every edit has its own text."""
    no, second = F.col("event_id") % 7, F.col("event_id") % 7 >= 3
    at = F.timestamp_millis(F.lit(1_000_000_000_000) + no * 100 + F.when(second, 5000).otherwise(0))
    edits = table(s, d, "events").select(F.floor(F.col("event_id") / 7).alias("draft_id"), at.alias("ts"), F.concat(F.when(no % 2 == 0, TOLD).otherwise(PLAIN), F.lit(" Edit "), F.col("event_id").cast("string"), F.lit(".")).alias("text"))
    end = s.createDataFrame([(-1, "2100-01-01 00:00:00", "the end of the stream")], "draft_id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    edits.repartition(4).write.parquet(path := new_folder(s, "edits"))
    stream = jobs.latest_drafts(_stream(edits, path))
    return _drained(stream.select("draft_id", "start", "text", (F.col("n_tells") > 0).alias("told")), "drafts", lambda: end.write.mode("append").parquet(path)).where("draft_id >= 0").select("draft_id", F.unix_millis("start").alias("start_ms"), "text", "told")


def running_counts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts per block arrive three times, in several batches and not in order of time; the latest of each block counts."""
    docs = table(s, d, "documents")
    verdict = lambda k: F.when((F.col("doc_id") + k) % 3 == 0, "slop").otherwise("clean")
    at = lambda k: F.timestamp_seconds(F.lit(1_000_000) + F.pmod(F.lit(2 * k) + F.col("doc_id"), F.lit(3)))
    once = lambda k: docs.select(F.col("source").alias("page_id"), F.col("doc_id").alias("block_id"), at(k).alias("ts"), verdict(k).alias("verdict"))
    stream = _arriving(once(0).unionByName(once(1)).unionByName(once(2)), "verdicts")
    path = new_folder(s, "counts")
    with _settings(s, jobs.STORE):
        jobs.count_changes(stream).writeStream.foreachBatch(jobs.add_changes(path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return jobs.current_counts(s, path)


QUERIES |= {"r1_score_blocks": score_blocks, "r2_changed_blocks": changed_blocks, "r2_rescored_blocks": rescored_blocks, "r3_latest_drafts": latest_drafts, "r4_running_counts": running_counts}
_LENGTH = "hour(ts::TIMESTAMP) + 1"
ORACLES |= {
    "r1_score_blocks": f"WITH {S.PLANTED_SQL}, {S.analysis_chain()} SELECT doc_id, density, verdict FROM analysis",
    "r2_changed_blocks": f"SELECT DISTINCT user_id AS block_id, ({_LENGTH})::INT AS length FROM events",
    "r2_rescored_blocks": f"WITH e AS (SELECT user_id AS block_id, ts::TIMESTAMP AS ts, ({_LENGTH})::BIGINT AS length FROM events), l AS (SELECT *, lag(length) OVER w AS before, lag(ts) OVER w AS then_ FROM e WINDOW w AS (PARTITION BY block_id ORDER BY ts, length)) "
    f"SELECT block_id, ts, length FROM l WHERE before IS NULL OR before <> length OR epoch_us(ts) - epoch_us(then_) > {KEEP_MS * 1000}",
    "r3_latest_drafts": f"WITH e AS (SELECT event_id, event_id // 7 AS draft_id, event_id % 7 AS no FROM events), b AS (SELECT draft_id, no >= 3 AS late, min(no) AS first, max(event_id) AS event_id, max(no) AS no FROM e GROUP BY ALL) "
    f"SELECT draft_id, 1000000000000 + first * 100 + CASE WHEN late THEN 5000 ELSE 0 END AS start_ms, CASE WHEN no % 2 = 0 THEN '{TOLD}' ELSE '{PLAIN}' END || ' Edit ' || event_id || '.' AS text, no % 2 = 0 AS told FROM b",
    "r4_running_counts": "WITH v AS (SELECT source AS page_id, doc_id, (2 * k + doc_id) % 3 AS no, (doc_id + k) % 3 = 0 AS slop FROM documents, (VALUES (0), (1), (2)) AS x(k)), c AS (SELECT page_id, count(*) FILTER (slop AND no = 2) AS n FROM v GROUP BY page_id) "
    "SELECT page_id, n, CASE WHEN n = 0 THEN '' WHEN n > 999 THEN '999+' ELSE n::VARCHAR END AS badge FROM c",
}
