"""Record streams of a crawl: routing, visits that become visible when they are finalised, windows and dedup.

A record is (record_type, visit_id, payload JSON, seq). Records of a visit are held in a list state, to which each batch
appends, until its ``finalize`` record; then they come out together, and a visit that was interrupted is marked
incomplete. A visit that is idle for the timeout is closed as failed. A closed visit leaves a mark behind: what comes for
it later is late and comes out as that, and never opens the visit again. The marks are dropped after ``forget`` (a visit's
number isn't used again for so long), so the state is bounded by the visits of that time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

FINALIZE = "finalize"
LATE = "late"
OUT_SCHEMA = "visit_id long, record_type string, payload string, status string"
OUT = Row("visit_id", "record_type", "payload", "status")


def valid(records: DataFrame, types: Sequence[str]) -> DataFrame:
    """Well-formed records: a known type, a visit and a payload that is a JSON object."""
    return records.filter(_ok(types))


def dead_letters(records: DataFrame, types: Sequence[str]) -> DataFrame:
    """The others, with the reason."""
    reason = F.when(F.col("visit_id").isNull(), "no visit_id").when(~F.coalesce(F.col("record_type").isin(FINALIZE, *types), F.lit(False)), "unknown type").otherwise("payload")
    return records.filter(~_ok(types)).withColumn("reason", reason)


def _ok(types: Sequence[str]) -> F.Column:
    known = F.col("record_type").isin(FINALIZE, *types)
    return F.coalesce(known & F.col("visit_id").isNotNull() & F.from_json("payload", "map<string,string>").isNotNull() & F.ltrim("payload").startswith("{"), F.lit(False))


class _Visits(StatefulProcessor):
    """The state of one visit: whether it is closed, its records so far, and a timer for when it is idle."""

    def __init__(self, timeout_ms: int, forget_ms: int):
        self.timeout_ms, self.forget_ms = timeout_ms, forget_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "closed boolean", self.forget_ms)
        self.held = handle.getListState("held", "record_type string, payload string")

    def _out(self, visit: int, rows: Iterable[tuple[str, str]], status: str) -> Iterator[Row]:
        for kind, payload in rows:
            yield OUT(visit, kind, payload, status)

    def _close(self, visit: int, rows: list[tuple[str, str]], buffered: bool, status: str) -> Iterator[Row]:
        """What is held, one by one, then the rows, then the finalize record."""
        if buffered:
            yield from self._out(visit, self.held.get(), status)
            self.held.clear()
        yield from self._out(visit, [*rows, (FINALIZE, "{}")], status)
        self.closed.update((True,))

    def _still(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        visit = key[0]
        new = sorted(((r["seq"], r["record_type"], r["payload"]) for r in rows), key=lambda r: (r[0], r[1] == FINALIZE))
        done = next((i for i, r in enumerate(new) if r[1] == FINALIZE), None)
        if self.closed.exists():
            own, late, done = [], new, None
        else:
            own, late = new[:done], new[done + 1 :] if done is not None else []
        if done is not None:
            success = json.loads(new[done][2]).get("success", True)
            buffered = self.held.exists()
            if buffered:
                self._still()
            yield from self._close(visit, [(k, p) for _, k, p in own], buffered, "complete" if success else "incomplete")
        elif own:
            if self.held.exists():
                self._still()
            self.held.appendList([(k, p) for _, k, p in own])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        if late:
            yield from self._out(visit, [(k, p) for _, k, p in late], LATE)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.closed.exists():
            yield from self._close(key[0], [], self.held.exists(), "failed")

    def close(self) -> None:
        pass


def visits(records: DataFrame, timeout_ms: int = 30_000, forget_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Streaming (visit_id, record_type, payload, status) of closed visits, ``complete``, ``incomplete`` (interrupted) or ``failed`` (idle), and of ``late`` records.

    Timers and list states need the RocksDB state store, so the session is set to it.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return records.groupBy("visit_id").transformWithState(_Visits(timeout_ms, forget_ms), OUT_SCHEMA, "append", "ProcessingTime")


def incomplete(finished: DataFrame) -> DataFrame:
    """Visits that were interrupted or went idle."""
    return finished.filter((F.col("record_type") == FINALIZE) & F.col("status").isin("incomplete", "failed")).select("visit_id")


def completed(finished: DataFrame) -> DataFrame:
    """The completion queue: (visit_id, success) of every closed visit."""
    return finished.filter((F.col("record_type") == FINALIZE) & (F.col("status") != LATE)).select("visit_id", (F.col("status") == "complete").alias("success"))


def route(batch: DataFrame, folder: str, types: Sequence[str]) -> None:
    """For ``foreachBatch``: one Parquet dataset per record type, in one pass over the batch."""
    batch.filter(F.col("record_type").isin(*types)).write.mode("append").partitionBy("record_type").parquet(folder)


def drain(batch_or_rest: DataFrame) -> DataFrame:
    """At the end of the stream: finalise markers for all visits that lack one, as failed."""
    g = batch_or_rest.groupBy("visit_id").agg(F.bool_or(F.col("record_type") == FINALIZE).alias("done"), F.max("seq").alias("seq"))
    return g.filter(~F.col("done")).select("visit_id", F.lit(FINALIZE).alias("record_type"), F.lit('{"success": false}').alias("payload"), (F.col("seq") + 1).alias("seq"))


def new_blobs(stream: DataFrame, key: str = "content_hash", event_time: str = "received_at", delay: str = "1 hour") -> DataFrame:
    """Content once per hash within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, event_time: str, key: str, value: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts and sums per key with a watermark."""
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return stream.withWatermark(event_time, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def sessions(stream: DataFrame, event_time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after the gap."""
    return stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count("*").alias("n"))


def site_states(transitions: DataFrame, now: F.Column, limit_s: int = 1800) -> DataFrame:
    """Latest state of each site (-1 not started, 0 waiting, 1 crawling, 2 ok, 3 error, 4 timeout); what is crawled for over the limit counts as timed out."""
    last = transitions.groupBy("site_id").agg(F.max(F.struct("at", "state")).alias("l"))
    late = (F.col("l.state") == 1) & (now.cast("long") - F.col("l.at").cast("long") > limit_s)
    return last.select("site_id", F.when(late, 4).otherwise(F.col("l.state")).alias("state"))


def claim(states: DataFrame, most: int) -> DataFrame:
    """The next sites to crawl: the first ``most`` that wait, by id, as transitions to state 1."""
    return states.filter("state = 0").orderBy("site_id").limit(most).select("site_id", F.lit(1).alias("state"))


def limited(spark: SparkSession, folder: str, schema: Any, files: int, **options: str) -> DataFrame:
    """A stream of files that takes at most ``files`` of them into a batch, so that no more is held before it is written out."""
    return spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", files).parquet(folder)


def to_table(stream: DataFrame, mode: str, folder: str, idle_s: float | None = None, timers: bool = False) -> DataFrame:
    """Run a stream over what its source holds now, and return what it wrote.

    With ``idle_s`` the stream runs on, so that timers fire, until a batch that began so many seconds after the last one with
    rows, in or out, has ended without any. However long batches take, timers of less than ``idle_s`` have fired then. A stream with
    ``timers`` asks for batches without data for ever, so without ``idle_s`` it gets none.
    """
    spark = stream.sparkSession
    wrote: set[int] = set()

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
        if idle_s is not None and not spark.read.schema(stream.schema).parquet(f"{folder}/out/epoch={epoch}").isEmpty():
            wrote.add(epoch)

    busy: dict[int, bool] = {}  # batch: whether it had rows
    begun: dict[int, datetime] = {}

    def over(q: StreamingQuery) -> bool:
        for p in q.recentProgress:
            busy[p["batchId"]] = busy.get(p["batchId"], False) or p["numInputRows"] > 0 or p["batchId"] in wrote
            begun[p["batchId"]] = datetime.fromisoformat(p["timestamp"])
        if not busy or busy[max(busy)]:
            return False
        last = max((begun[b] for b in busy if busy[b]), default=min(begun.values()))
        return (begun[max(busy)] - last).total_seconds() >= (idle_s or 0)

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    if idle_s is None:
        # rows that are only added go to files without a way through Python
        started = started.format("parquet").option("path", f"{folder}/out") if mode == "append" else started.foreachBatch(keep)
        setting = "spark.sql.streaming.noDataMicroBatches.enabled"
        before = spark.conf.get(setting)
        spark.conf.set(setting, str(not timers).lower())
        try:
            q = started.trigger(availableNow=True).start()  # takes the settings as they are now
        finally:
            spark.conf.set(setting, before)
        q.awaitTermination()
    else:
        q = started.foreachBatch(keep).trigger(processingTime="500 milliseconds").start()
        try:
            while q.isActive and not over(q):
                q.awaitTermination(0.5)
            if q.exception() is not None:
                raise q.exception()
        finally:
            q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def rows_done(q: StreamingQuery) -> int:
    """Rows that a streaming query has read, from its progress reports."""
    return sum(p["numInputRows"] for p in q.recentProgress)


class Status(StreamingQueryListener):
    """Counters of the queries of a session while it is registered (``spark.streams.addListener``): batches, rows read, queries that run."""

    def __init__(self) -> None:
        self.batches = self.rows = self.running = 0

    def onQueryStarted(self, event: Any) -> None:
        self.running += 1

    def onQueryProgress(self, event: Any) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.running -= 1
