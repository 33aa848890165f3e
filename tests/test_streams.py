"""Streams with state: several batches, late rows, state that expires, changes that are taken back."""

import datetime as dt

from pyspark.sql import functions as F

from proselens.plans.stream_queries import _drained, _settings, _stream
from proselens.scratch import new_folder
from proselens.streaming import jobs

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EDITS = "block_id long, ts timestamp, text string"


def at(minute):
    return BASE + dt.timedelta(minutes=minute)


def write(spark, batches, schema, name):
    path = new_folder(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_rescored_across_batches(spark):
    batches = [
        [(1, at(0), "aa"), (2, at(5), "a"), (1, at(30), "aa")],
        [(1, at(40), "aaa"), (1, at(20), "b"), (2, at(50), "a")],  # twenty minutes late: found in its place
        [(1, at(60), "ccc"), (2, at(55), "zz"), (3, at(0), "too late, as the watermark is past it")],
        [(2, at(600), "zz"), (1, at(610), "ddd")],  # long after: as if new
        [(9, at(100_000), "the end")],
    ]
    path = write(spark, batches, EDITS, "edits")
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(path)
    found = _drained(jobs.rescored_blocks(stream, "30 minutes", 3 * 3_600_000, 600_000), "out", settings=jobs.STORE).collect()
    minutes = sorted((r.block_id, round((r.ts.replace(tzinfo=dt.timezone.utc) - BASE).total_seconds() / 60), r.length) for r in found if r.block_id < 9)
    assert minutes == [(1, 0, 2), (1, 20, 1), (1, 30, 2), (1, 40, 3), (1, 610, 3), (2, 5, 1), (2, 55, 2), (2, 600, 2)]


def test_counts_after_every_batch(spark):
    schema = "page_id string, block_id long, ts timestamp, verdict string"
    batches = [
        [("p", 1, at(0), "slop"), ("p", 2, at(0), "clean"), ("q", 1, at(0), "clean")],
        [("p", 1, at(1), "clean"), ("p", 2, at(1), "slop"), ("p", 3, at(1), "slop"), ("p", 3, at(1), "slop")],
        [("p", 1, at(0), "slop"), ("q", 1, at(5), "slop"), ("q", 1, at(4), "clean"), (None, 1, at(0), "slop")],  # an older verdict changes nothing
        [("p", 3, at(2), None), ("p", 2, at(1), "clean")],  # of two verdicts of one time the first by name
    ]
    path, counts = write(spark, batches, schema, "verdicts"), new_folder(spark, "counts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    seen = []

    def add(batch, number):
        for _ in range(2):  # a retried batch replaces its own version
            jobs.add_changes(counts)(batch, number)
        seen.append({r.page_id: r.n for r in jobs.current_counts(spark, counts).collect()})

    with _settings(spark, jobs.STORE):
        jobs.count_changes(stream).writeStream.foreachBatch(add).option("checkpointLocation", f"{counts}-state").trigger(availableNow=True).start().awaitTermination()
    arrived, want = [], []
    for rows in batches:
        arrived += rows
        last = {}
        for page, block, ts, verdict in arrived:
            now, before = (ts, verdict or "clean"), last.get((page, block))
            if before is None or (-now[0].timestamp(), now[1]) < (-before[0].timestamp(), before[1]):
                last[page, block] = now
        pages = {page: 0 for page, _ in last}
        for (page, _), (_, verdict) in last.items():
            pages[page] += verdict == "slop"
        want.append(pages)
    assert [x for i, x in enumerate(seen) if i == 0 or x != seen[i - 1]] == [x for i, x in enumerate(want) if i == 0 or x != want[i - 1]] and seen[-1] == want[-1]
    assert jobs.current_counts(spark, new_folder(spark, "none")).count() == 0


def test_settings_come_back(spark):
    key = next(iter(jobs.STORE))
    before = spark.conf.get(key, None)
    with _settings(spark, jobs.STORE):
        assert spark.conf.get(key) == jobs.STORE[key]
    assert spark.conf.get(key, None) == before and _stream and F


class _Handle:
    """State of one key in memory; counts calls that read or write values."""

    def __init__(self):
        self.calls, self.timers, self.map, self.value = 0, set(), {}, None
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def listTimers(self):
        return iter(list(self.timers))

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def keys(self):
        return iter([(k,) for k in self.map])

    def getValue(self, key):
        self.calls += 1
        return self.map[key[0]]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key[0]] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key[0]]

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None


def test_state_is_called_by_the_bucket_not_by_the_row(monkeypatch):
    """Thousands of rows of hundreds of blocks, one of them with half of all rows, in four batches that overlap: the plain loop's rows, and few calls."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(jobs, "HELD_ROWS", 500)
    rnd, hour, keep = random.Random(5), 3_600_000, 6 * 3_600_000
    arrivals = [(rnd.choice([None, "hot", "hot", str(rnd.randrange(300))]), rnd.randrange(4 * 24 * hour) * 1000 + rnd.randrange(1000), rnd.randrange(1, 4)) for _ in range(6000)]
    arrivals += arrivals[:50]
    arrivals.sort(key=lambda r: r[1] + rnd.randrange(2 * hour) * 1000)
    handle, found, now = _Handle(), [], 0
    state = jobs._InOrder(hour, keep)
    state.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    for batch in (arrivals[:2000], arrivals[2000:4000], arrivals[4000:], None):
        if batch:
            frames = [pd.DataFrame(batch[k : k + 300], columns=["block", "us", "length"]) for k in range(0, len(batch), 300)]
            assert not list(state.handleInputRows((0,), iter(frames), clock))
        for timer in [x for x in handle.timers if x <= now]:
            handle.timers.discard(timer)
            found += [tuple(r) for part in state.handleExpiredTimer((0,), clock, timer) for r in part.itertuples(index=False)]
        now = max(r[1] for r in batch) // 1000 - 2 * hour if batch else now
    now = 10_000 * hour
    while handle.timers:  # the end of the stream, and the last state goes
        timer = min(handle.timers)
        handle.timers.discard(timer)
        found += [tuple(r) for part in state.handleExpiredTimer((0,), clock, timer) for r in part.itertuples(index=False)]
    want, last = [], {}
    for block, us, length in sorted(set(arrivals), key=lambda r: r[1:]):
        before = last.get(block)
        if before is None or before[1] != length or us - before[0] > keep * 1000:
            want.append((block, us, length))
        last[block] = us, length
    order = lambda r: (r[1], r[2], r[0] or "")
    assert sorted(found, key=order) == sorted(want, key=order) and len(want) > 1000
    assert not handle.map and handle.value is None
    assert handle.calls < 1200 < len(arrivals)


def test_rescored_keys_of_strings_and_null(spark):
    schema = EDITS.replace("block_id long", "name string")
    batches = [[("a", at(0), "x"), (None, at(1), "x"), (None, at(2), "x"), (None, at(3), "xx")], [("a", at(4), "x"), ("b", at(5), "x"), (None, None, "x")], [("end", at(100_000), "the end")]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(write(spark, batches, schema, "names"))
    found = _drained(jobs.rescored_blocks(stream, key="name"), "named", settings=jobs.STORE).collect()
    assert sorted((str(r["name"]), r["length"]) for r in found if r["name"] != "end") == [("None", 1), ("None", 2), ("a", 1), ("b", 1)]
