"""Jobs as a stream with keyed state: each job's row as it changes, timers for those that run too long."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import FINAL

#: Of changes at the same time that with the later status counts.
ORDER = {"pending": 0, "running": 1, "completed": 2, "failed": 3, "timeout": 4}
#: Of a bucket of jobs: by job its fields as in _FIELDS and when its timer is due, pickled; and the bucket's timer, the first of these.
_STATE = "jobs binary, timer long"
_FIELDS = "job_type string, status string, at timestamp, started_at timestamp, completed_at timestamp, version long"
_OUT = "job_id {id}, " + _FIELDS
#: A job without changes yet.
_NEW = (None, None, None, None, None, 0, None)


def _ms(t: datetime) -> int:
    """Milliseconds since 1970 of a time as Spark hands it to Python: without a zone, in the machine's."""
    return int(t.astimezone(timezone.utc).timestamp() * 1000)


class Jobs(StatefulProcessor):
    """The state of a bucket of jobs, one value read and written once for all changes of a batch, and one timer: that of the job due first."""

    def __init__(self, limits: dict[str, int], default: int):
        self.limits, self.default = limits, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _held(self) -> tuple[dict, int | None]:
        old = self.bucket.get()
        return ({}, None) if old is None else (pickle.loads(old[0]), old[1])

    def _keep(self, jobs: dict, timer: int | None, fired: bool = False) -> None:
        first = min((due for *_, due in jobs.values() if due is not None), default=None)
        if first != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if jobs:
            self.bucket.update((pickle.dumps(jobs), first))
        else:
            self.bucket.clear()

    def _due(self, kind: str | None, at: datetime | None, started: datetime | None, completed: datetime | None) -> int | None:
        if completed is not None:
            return _ms(max(completed, at)) + 1
        return None if started is None else _ms(self._limit(kind, started)) + 1

    def _limit(self, kind: str | None, started: datetime) -> datetime:
        return started + timedelta(seconds=self.limits.get(kind, self.default))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        jobs, timer = self._held()
        before: dict = {}
        for job, new_kind, new_status, ts, _ in rows:
            kind, status, at, started, completed, version, due = old = jobs.get(job, _NEW)
            before.setdefault(job, old)
            kind = kind if new_kind is None else new_kind
            if at is None or (ts, ORDER.get(new_status, -1)) >= (at, ORDER.get(status, -1)):
                status, at = new_status, ts
            if new_status == "running":
                started = ts if started is None else min(started, ts)
            elif new_status in FINAL:
                completed = ts if completed is None else min(completed, ts)
            jobs[job] = (kind, status, at, started, completed, version, due)
        out = []
        for job, old in before.items():
            kind, status, at, started, completed, version, _ = jobs[job]
            changed = (kind, status, at, started, completed) != old[:5]
            jobs[job] = (kind, status, at, started, completed, version + changed, self._due(kind, at, started, completed))
            if changed:
                out.append(Row(job_id=job, job_type=kind, status=status, at=at, started_at=started, completed_at=completed, version=version + 1))
        self._keep(jobs, timer)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        jobs, timer = self._held()
        if timer != fired:
            return
        # all that Spark would fire now: those due up to the watermark, in the order of their timers
        now = timerValues.getCurrentWatermarkInMs()
        over = sorted((j for j, (*_, due) in jobs.items() if due is not None and due <= now), key=lambda j: jobs[j][-1])
        ended = [(job, jobs.pop(job)) for job in over]
        self._keep(jobs, timer, fired=True)
        for job, (kind, _, _, started, completed, version, _) in ended:
            if completed is None:
                end = self._limit(kind, started)
                yield Row(job_id=job, job_type=kind, status="timeout", at=end, started_at=started, completed_at=end, version=version + 1)

    def close(self) -> None:
        pass


def job_updates(changes: DataFrame, limits: dict[str, int], default: int = 600, late: str = "0 seconds", buckets: int = 1 << 14) -> DataFrame:
    """(job_id, job_type, status, at, started_at, completed_at, version): a streaming row whenever a job's state changes.

    changes(id, job_type, status, ts) is a stream, in any order and with repetitions: status is that of the
    latest change, started_at the first running one, completed_at the first final one. A job that
    runs on when the watermark, `late` behind the latest change, is past started_at and the limit of its
    kind, in seconds, becomes `timeout` at that time, by a timer. State is let go when the watermark is past
    the final change, or with the timeout: what is held is the jobs that wait, run, or have just ended. Changes
    from before the watermark are dropped by Spark, so none can come for what was let go; a later one begins
    the job anew. A job that only waits is held until it starts. version counts the rows of a job since it began.

    Python reaches the state by calls to Spark, several a key, so the keys are buckets of jobs by a hash of their id: calls
    grow with the buckets that a batch touches, not with its jobs. A touched bucket is read and written whole, all its held jobs,
    so there should be many. With a checkpoint the number of buckets can't change.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(changes.dtypes)["id"]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = changes.select("id", "job_type", "status", "ts", bucket).withWatermark("ts", late).groupBy("bucket")
    return keyed.transformWithState(Jobs(limits, default), _OUT.format(id=kind), "Update", "EventTime")


def follow(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A query that takes what is there and ends: each batch's rows are a folder of their own, so a batch that is run again replaces its rows.

    Started again with the same checkpoint it goes on where it ended.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return updates.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each job that follow() wrote; Spark may hand a job's rows of a batch over in parts, so it can have several there."""
    rows = spark.read.parquet(folder)
    newest = F.struct("batch", "version")
    out = rows.groupBy("job_id").agg(F.max_by(F.struct("job_type", "status", "at", "started_at", "completed_at"), newest).alias("job"))
    return out.select("job_id", "job.*")
