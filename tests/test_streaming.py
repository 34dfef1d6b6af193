"""Streams over several time-ordered files, late rows included, against the same rows as a batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuework.streaming import jobs

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, text string, state string, secs double, v long"


def at(seconds):
    return DAY0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    """run(batches, make, mode): rows that the stream gives, each with the number of its batch, and the states kept."""
    def go(batches, make, mode="append"):
        folder = tmp_path / str(random.random())
        beat = [[(None, at(10**8), None, None, 0.0, 0)], [(None, at(10**8 + 1), None, None, 0.0, 0)]]
        for i, rows in enumerate([*batches, *beat]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / "in" / f"n={i}"))
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "n=*"))
        out, states = [], []
        q = make(src).writeStream.outputMode(mode).option("checkpointLocation", str(folder / "c")).trigger(
            availableNow=True).foreachBatch(lambda df, b: out.extend((b, r) for r in df.collect())).start()
        q.awaitTermination()
        for p in q.recentProgress:
            states += [s["numRowsTotal"] for s in p["stateOperators"][:1]]
        return [(b, r) for b, r in out if r.k is not None], states
    return go


def spread(rng, n, late, keys="ab"):
    """``n`` rows over 1000 seconds in four slices; some come one slice late."""
    rows = [(rng.choice(keys), at(round(rng.uniform(0, 1000), 3)), f"w{i}", "x", round(rng.uniform(0, 6), 2), i) for i in range(n)]
    batches = [[] for _ in range(5)]
    for r in rows:
        slice_ = min(3, int((r[1] - DAY0).total_seconds() // 250))
        batches[slice_ + (rng.random() < late)].append(r)
    return rows, [b for b in batches if b]


def test_refills_are_those_of_a_batch(spark, run):
    rng = random.Random(1)
    rows, batches = spread(rng, 150, 0.2)
    make = lambda df: jobs.ttl_dedupe(df.select("k", "ts", "v"), ["k"], "ts", 60, "600 seconds")
    got, states = run(batches, make)
    want = make(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.k, r.ts, r.v) for _, r in got) == sorted((r.k, r.ts, r.v) for r in want) and len(want) > 20
    assert states[-1] < max(states)


def test_refill_after_the_time_to_live_only(run):
    fills = [(0, "a"), (7 * 86400, "a"), (7 * 86400 + 1, "a"), (50 * 86400, "a"), (50 * 86400, "b")]
    batches = [[(k, at(s), None, None, 0.0, i)] for i, (s, k) in enumerate(fills)]
    got, _ = run(batches, lambda df: jobs.ttl_dedupe(df.select("k", "ts", "v"), ["k"]))
    assert sorted(r.v for _, r in got) == [0, 2, 3, 4]


@pytest.mark.parametrize("length", [None, "secs"])
def test_pause_groups_are_those_of_a_batch(spark, run, length):
    rng = random.Random(2)
    rows, batches = spread(rng, 500, 0.2)
    make = lambda df: jobs.pause_groups(df, ["k"], "ts", "text", 6.0, 8, "600 seconds", length)
    got, _ = run(batches, make)
    want = make(spark.createDataFrame(rows, SCHEMA)).collect()
    line = lambda r: (r.k, r.start, r.end, r["items"], r.text)
    assert sorted(line(r) for _, r in got) == sorted(line(r) for r in want)
    assert max(r["items"] for r in want) == 8 and len(want) > 30


def test_state_is_held_by_buckets_of_keys(run):
    """Keys of several columns come back as they were, and a bucket has few states however many keys it has."""
    keys = [(k, (1 << 60) + i) for i in range(200) for k in ("a", 'b"\\')]
    batches = [[(k, at(1000 * b), "w", None, 0.0, v) for k, v in keys] for b in range(2)]
    for make, out in ((lambda df: jobs.ttl_dedupe(df.select("k", "v", "ts"), ["k", "v"], "ts", 60, "10 seconds", buckets=4), "ts"),
                      (lambda df: jobs.pause_groups(df, ["k", "v"], "ts", "text", 60, 8, "10 seconds", buckets=4), "start")):
        got, states = run(batches, make)
        assert sorted((r.k, r.v, r[out]) for _, r in got) == sorted((k, v, at(1000 * b)) for k, v in keys for b in range(2))
        assert max(states) < 50


def test_rows_without_a_length_end_where_they_start(spark, run):
    rows = [("a", at(0), "x", None, 5.0, 0), ("a", at(4), "y", None, None, 1), ("a", at(6), "z", None, None, 2)]
    make = lambda df: jobs.pause_groups(df, ["k"], "ts", "text", 1.5, 8, "10 seconds", "secs")
    got, _ = run([rows], make)
    want = make(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.text, r.end) for _, r in got) == sorted((r.text, r.end) for r in want) == [("x y", at(5)), ("z", at(6))]


def test_groups_do_not_wait_for_a_pause(run):
    """A key that never pauses gives full groups out as it goes."""
    batches = [[("a", at(100 * b + i), f"w{b}{i}", None, 0.0, 0) for i in range(100)] for b in range(4)]
    got, states = run(batches, lambda df: jobs.pause_groups(df, ["k"], "ts", "text", 5.0, 8, "10 seconds"))
    assert {b for b, _ in got} >= {1, 2, 3} and sum(r["items"] for _, r in got) == 400
    assert max(states) < 120


def test_finished_jobs_are_forgotten_and_stay_closed(spark, run):
    def row(k, s, state):
        return (k, at(s), None, state, 0.0, 0)
    batches = [[row("a", 0, "running"), row("b", 1, "running"), row("c", 2, "queued")],
               [row("a", 10, "done"), row("a", 20, "running"), row("b", 21, "running")],
               [row("a", 8, "error"), row("c", 30, "running")],  # an earlier end comes late
               [row("b", 500, "running")], [row("b", 1000, "running")],
               [row("a", 15, "running"), row("b", 1500, "done")]]  # far too late: does not open a again
    got, states = run(batches, lambda df: jobs.job_state_stream(df.select("k", "ts", "state"), ["k"], delay="50 seconds",
                                                                keep_seconds=100.0), "update")
    last = {}
    for _, r in sorted(got, key=lambda x: x[0]):
        last[r.k] = (r.ts, r.state)
    assert last == {"a": (at(8), "error"), "b": (at(1500), "done"), "c": (at(30), "running")}
    assert [r.state for _, r in got if r.k == "a"] == ["running", "done", "error"]
    batch = jobs.latest_state(spark.createDataFrame([r for b in batches for r in b], SCHEMA), ["k"]).collect()
    assert {r.k: (r.ts, r.state) for r in batch} == last
    assert states[-1] < max(states)


def test_repeated_batches_count_once(spark, tmp_path):
    schema = "k string, v long, created_at long, updated_at long"
    one = spark.createDataFrame([("a", 1, 1, 1)], schema)
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "none*"))
    held = {}

    class Writer:
        def __getattr__(self, name):
            return lambda *args: held.update({name: args}) or self
    from unittest import mock
    with mock.patch.object(type(src), "writeStream", Writer()):
        jobs.upsert_stream(src, str(tmp_path / "t"), ["k"], ["v"], "updated_at", "c", 4)
    apply = held["foreachBatch"][0]
    apply(one, 0)
    apply(one.withColumn("v", F.lit(7).cast("long")).withColumn("updated_at", F.lit(2).cast("long")), 1)
    apply(one.withColumn("v", F.lit(9).cast("long")).withColumn("updated_at", F.lit(3).cast("long")), 1)
    from cuework.sources.versions import commits, read_buckets
    assert [tuple(r) for r in read_buckets(spark, str(tmp_path / "t"), schema).collect()] == [("a", 7, 1, 2)]
    assert commits(spark, str(tmp_path / "t")) == [0, 1]
