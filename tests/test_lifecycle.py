"""The keyed-state job stream against the batch, over files that come in any order, with a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.streaming import lifecycle

SCHEMA = "id long, job_type string, status string, ts timestamp"
T0 = datetime(2024, 1, 1)
LIMITS = {"extract": 300, "sync_subtitles": 7200}


def changes(seed, jobs, begin):
    """Changes of jobs in some hours, shuffled, some repeated: half end within their limit, some run on, some only wait."""
    r = random.Random(seed)
    rows = []
    for i in jobs:
        kind, at = r.choice(["extract", "sync_subtitles", None]), begin + timedelta(seconds=r.randint(0, 3000), microseconds=r.randint(0, 999_999))
        limit = LIMITS.get(kind, 600)
        mine = [(i, kind, "pending", at)]
        if r.random() < 0.8:
            start = at + timedelta(seconds=r.randint(1, 60))
            mine.append((i, kind, "running", start))
            if r.random() < 0.7:
                mine.append((i, kind, r.choice(["completed", "failed"]), start + timedelta(seconds=r.randint(0, limit - 1))))
        rows += mine + [r.choice(mine)]
    r.shuffle(rows)
    return rows


def run(spark, folder, wait=True):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = lifecycle.follow(lifecycle.job_updates(stream, LIMITS, late="10 minutes"), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return query


def held(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]


def expected(spark, rows, now):
    """The batch's states; running jobs that are over their limit by then have timed out."""
    df = spark.createDataFrame(rows, SCHEMA)
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(k)) for s, k in lifecycle.ORDER.items()])
    states = streaming.job_states(df.select("id", "status", F.struct("ts", rank.alias("rank")).alias("ts"))).collect()
    kinds, out = {i: k for i, k, _, _ in rows}, {}
    for s in states:
        start, end = s.started_at and s.started_at.ts, s.completed_at and s.completed_at.ts
        out[s.job_id] = (kinds[s.job_id], s.status, s.at.ts, start, end)
        due = start and start + timedelta(seconds=LIMITS.get(kinds[s.job_id], 600))
        if start and not end and now - due >= timedelta(milliseconds=2):
            out[s.job_id] = (kinds[s.job_id], "timeout", due, start, due)
    return out


def test_stream_is_the_batch(spark, tmp_path):
    """Three lots of files, a restart before each: final rows are the batch's, timers fire the timeouts, state of ended jobs is let go."""
    folder, rows = str(tmp_path), []
    for k in range(3):
        lot = changes(k, range(k * 60, k * 60 + 60), T0 + timedelta(hours=6 * k))
        rows += lot
        spark.createDataFrame(lot, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
        query = run(spark, folder)
        now = max(r[3] for r in rows) - timedelta(minutes=10)
        want = expected(spark, rows, now)
        got = {r.job_id: tuple(r)[1:] for r in lifecycle.latest(spark, f"{folder}/out").collect()}
        assert got == want
        # what is held has not ended, or ended after the watermark
        open_jobs = sum(1 for _, status, at, _, end in want.values() if end is None or max(at, end) > now - timedelta(milliseconds=1))
        assert held(query) <= open_jobs < len(want)
    statuses = {s for _, s, *_ in got.values()}
    assert statuses == {"pending", "running", "completed", "failed", "timeout"} or statuses == {"pending", "completed", "failed", "timeout"}
    before = sorted(map(str, lifecycle.latest(spark, f"{folder}/out").collect()))
    run(spark, folder)  # nothing new: nothing changes
    assert sorted(map(str, lifecycle.latest(spark, f"{folder}/out").collect())) == before


def test_a_job_begins_anew(spark, tmp_path):
    """A change after a job was let go begins it anew; nulls in kinds and times of equal changes have a defined result."""
    folder = str(tmp_path)
    at = lambda m: T0 + timedelta(minutes=m)
    first = [(1, "extract", "running", at(0)), (1, None, "completed", at(1)), (2, None, "pending", at(300)), (None, "extract", "running", at(300)), (3, "extract", "failed", at(5)), (3, "extract", "running", at(5))]
    spark.createDataFrame(first, SCHEMA).write.parquet(f"{folder}/in")
    run(spark, folder)
    spark.createDataFrame([(1, "extract", "running", at(400))], SCHEMA).write.mode("append").parquet(f"{folder}/in")
    run(spark, folder)
    got = {r.job_id: (r.status, r.started_at, r.completed_at) for r in lifecycle.latest(spark, f"{folder}/out").collect()}
    assert got == {1: ("running", at(400), None), 2: ("pending", None, None), None: ("timeout", at(300), at(305)), 3: ("failed", at(5), at(5))}


def test_calls_grow_with_buckets(spark, tmp_path, monkeypatch):
    """A bucket's state is read and written once a batch, whatever the number of its jobs; results and lots are as with a bucket a job."""
    class Calls:
        def __init__(self):
            self.value, self.seen, self.timers = None, [], set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.seen.append("get")
            return self.value

        def update(self, value):
            self.seen.append("update")
            self.value = value

        def clear(self):
            self.seen.append("clear")
            self.value = None

        def registerTimer(self, at):
            self.seen.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.seen.append("delete")
            self.timers.remove(at)

    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    calls, jobs = Calls(), lifecycle.Jobs(LIMITS, 600)
    jobs.init(calls)
    rows = [(i, "extract", s, T0 + timedelta(minutes=i + 60 * (s == "completed")), 0) for i in range(1000) for s in (["running", "completed"] if i % 2 else ["running"])]
    assert len(list(jobs.handleInputRows((0,), iter(rows), TimerValues()))) == 1000 and len(calls.seen) == 3
    # at 500 minutes those that run since 495 or before are over, those that ended by then go
    (first,) = calls.timers
    calls.timers.clear()  # as Spark does with one that fires
    out = list(jobs.handleExpiredTimer((0,), TimerValues(0, lifecycle._ms(T0 + timedelta(minutes=500))), ExpiredTimerInfo(first)))
    assert [r.job_id for r in out] == list(range(0, 495, 2)) and {r.status for r in out} == {"timeout"} and len(calls.seen) == 6
    assert calls.timers == {lifecycle._ms(T0 + timedelta(minutes=501)) + 1}

    folder, rows = str(tmp_path), []
    for k in range(2):
        lot = changes(7 + k, range(k * 80, k * 80 + 80), T0 + timedelta(hours=6 * k))
        rows += lot
        spark.createDataFrame(lot, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        lifecycle.follow(lifecycle.job_updates(stream, LIMITS, late="10 minutes", buckets=3), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        got = {r.job_id: tuple(r)[1:] for r in lifecycle.latest(spark, f"{folder}/out").collect()}
        assert got == expected(spark, rows, max(r[3] for r in rows) - timedelta(minutes=10))
