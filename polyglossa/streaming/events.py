"""Event streams: duplicates, windows, quotas, alerts, job states, ingest, and lines translated against a fixed memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from polyglossa.operators.retention import admit
from polyglossa.operators.tm import tm_lookup


def event_dedup_stream(events: DataFrame, delay: str = "1 hour", keys=("user_id", "event_type", "message")) -> DataFrame:
    """The first of equal events that lie within the delay; state is dropped behind the watermark. events: ts (timestamp) and keys."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, gap: str | None = None, delay: str = "1 hour") -> DataFrame:
    """start, end, event_type, n in tumbling, sliding or (with gap) session windows; rows past the watermark are dropped."""
    span = F.session_window("ts", gap) if gap else F.window("ts", size, slide)
    counts = events.withWatermark("ts", delay).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select("w.start", "w.end", "event_type", "n")


def translate_stream(lines: DataFrame, index: DataFrame, path: str, checkpoint: str):
    """A query that looks up each batch of lines in the memory's index and appends it as Parquet.

    A batch is written to its own folder, so that one that runs again after a failure replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        tm_lookup(batch, index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay)


#: The state store that streams with state variables and timers need: setting and value.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _only_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer for the key, in place of those it has."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


class UploadQuota(StatefulProcessor):
    """Of one user: a count of admitted attempts and when it expires, with an event-time timer that drops both."""

    def __init__(self, limit: int, gap_s: int) -> None:
        self.limit, self.gap_s = limit, gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "n int, until double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = tuple(self.held.get()) if self.held.exists() else (0, float("-inf"))
        flags, (n, until) = admit([t.timestamp() for t in new["ts"]], held, self.limit, self.gap_s)
        self.held.update((n, until))
        _only_timer(self.handle, max(int(until * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": new["event_id"], "ts": new["ts"], "admitted": flags})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def upload_quota_stream(attempts: DataFrame, limit: int = 5, gap_s: int = 3600, delay: str = "1 hour") -> DataFrame:
    """user_id, event_id, ts, admitted: the quota of retention.upload_quota over a stream. attempts: user_id (long), event_id (long), ts (timestamp).

    A user's state goes when the watermark passes its expiry. Attempts of one trigger are judged in order of time; those older than what
    was judged before see the newer state. All attempts of a user are judged in one task: each depends on those before. The session
    needs ROCKSDB as its state store.
    """
    return _keyed(attempts.select("user_id", "event_id", "ts"), delay).groupBy("user_id").transformWithStateInPandas(
        UploadQuota(limit, gap_s), outputStructType="user_id long, event_id long, ts timestamp, admitted boolean", outputMode="append", timeMode="EventTime"
    )


class StaleWatch(StatefulProcessor):
    """Of one job: its latest active update as a value, and one event-time timer for the moment when it becomes stale."""

    def __init__(self, minutes: int, active: tuple[str, ...]) -> None:
        self.wait, self.active = minutes * 60_000, active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "status string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        status, last = new["status"].iloc[-1], int(new["ts"].iloc[-1].value // 1000)
        if self.last.exists():
            held = self.last.get()
            if held[1] > last:
                status, last = held
        if status in self.active:
            self.last.update((status, last))
            _only_timer(self.handle, max(last // 1000 + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.last.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"job": [key[0]], "status": [status], "last": [pd.Timestamp(last, unit="us")]})

    def close(self) -> None:
        pass


def stale_alerts(updates: DataFrame, minutes: int, active: tuple[str, ...], delay: str = "10 minutes") -> DataFrame:
    """job, status, last: an alert for a job that stays active without an update for the given minutes of event time. updates: job (string), status, ts.

    The latest update by time counts, so late ones do not hide newer ones; repeated ones change nothing. An alert comes once; a new
    update arms the job again. State and timers are in the checkpoint, so a restarted query goes on where it stopped. The session needs
    ROCKSDB as its state store.
    """
    return _keyed(updates.select("job", "status", "ts"), delay).groupBy("job").transformWithStateInPandas(
        StaleWatch(minutes, active), outputStructType="job string, status string, last timestamp", outputMode="append", timeMode="EventTime"
    )


def fold_job_state(updates: DataFrame, final: str) -> DataFrame:
    """job, status, n: each job's latest status, the final one never overwritten; the batch form is review.fold_status. updates: job, status, ts, event_id. For update or complete mode."""
    made = updates.groupBy("job").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"), F.coalesce(F.max(F.col("status") == final), F.lit(False)).alias("done"), F.count("*").alias("n"))
    return made.select("job", F.when(F.col("done"), final).otherwise(F.col("last.status")).alias("status"), "n")


def ingest_stream(rows: DataFrame, good: str, bad: str, checkpoint: str):
    """A query that parts each batch of pairs (record_id, source_text, target_text): usable rows to `good`, others with their reason to `bad`.

    Each batch has its own folder in both, so one that runs again after a failure replaces what it wrote.
    """
    source, target = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("source_text", "target_text"))
    reason = (
        F.when(F.coalesce(F.trim("record_id"), F.lit("")) == "", "no id").when(source == "", "blank source").when(target == "", "blank target")
        .when(source == target, "copy").when(F.concat(source, target).contains("�"), "replacement character")
    )

    def put(batch: DataFrame, number: int) -> None:
        told = batch.withColumn("reason", reason).persist()
        told.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        told.filter("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        told.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
