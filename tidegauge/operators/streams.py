"""Streaming queries over the events table, run to the end of what it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators.io import folder
from tidegauge.registry import query, table
from tidegauge.streaming import ingest as I
from tidegauge.streaming.leases import leases

TYPES = ["click", "view", "purchase", "signup"]


def events(s, d):
    """The events file as a stream."""
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def records(s, d):
    """Events as crawl records: an error event finalises its visit (one user's day)."""
    kind = F.when(F.col("event_type") == "error", I.FINALIZE).otherwise(F.col("event_type"))
    visit = F.when(F.col("event_id") % 97 != 0, F.col("user_id") * 100 + F.dayofmonth("ts"))
    payload = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, '{"success": true}').otherwise('{"success": false}')).when(F.col("event_id") % 89 == 0, "broken").otherwise(F.col("props"))
    return events(s, d).select(F.col("event_id").alias("seq"), kind.alias("record_type"), visit.cast("long").alias("visit_id"), payload.alias("payload"))


_RECORDS = """r AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'finalize' ELSE event_type END AS record_type, CASE WHEN event_id % 97 <> 0 THEN user_id * 100 + day(ts) END AS visit_id,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN '{"success": true}' ELSE '{"success": false}' END WHEN event_id % 89 = 0 THEN 'broken' ELSE props END AS payload FROM events)"""
_VALID = f"{_RECORDS}, v AS (SELECT * FROM r WHERE visit_id IS NOT NULL AND payload <> 'broken'), e AS (SELECT visit_id, min(seq) AS done, arg_min(payload, seq) AS mark FROM v WHERE record_type = 'finalize' GROUP BY visit_id)"


def _finished(s, d):
    return I.to_table(I.visits(I.valid(records(s, d), TYPES)), "append", folder(s), timers=True)


def _rows(finished):
    return finished.filter((F.col("record_type") != I.FINALIZE) & (F.col("status") != I.LATE))


@query("st_record_router", f"WITH {_RECORDS} SELECT record_type, count(*) AS n FROM r WHERE visit_id IS NOT NULL AND payload <> 'broken' AND record_type <> 'finalize' GROUP BY record_type")
def _(s, d):
    at = folder(s)
    stream = I.valid(records(s, d), TYPES)
    q = stream.writeStream.foreachBatch(lambda b, e: I.route(b, f"{at}/out", TYPES)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("record_type").agg(F.count("*").alias("n"))


@query("st_dead_letter", f"WITH {_RECORDS} SELECT CASE WHEN visit_id IS NULL THEN 'no visit_id' ELSE 'payload' END AS reason, count(*) AS n FROM r WHERE visit_id IS NULL OR payload = 'broken' GROUP BY 1")
def _(s, d):
    return I.to_table(I.dead_letters(records(s, d), TYPES), "append", folder(s)).groupBy("reason").agg(F.count("*").alias("n"))


@query("st_finalize", f"WITH {_VALID} SELECT v.visit_id, count(*) AS n FROM v JOIN e USING (visit_id) WHERE v.record_type <> 'finalize' AND v.seq < done GROUP BY v.visit_id")
def _(s, d):
    return _rows(_finished(s, d)).groupBy("visit_id").agg(F.count("*").alias("n"))


@query("st_visit_buffer", f"WITH {_VALID} SELECT v.visit_id, v.record_type, v.payload FROM v JOIN e USING (visit_id) WHERE v.record_type <> 'finalize' AND v.seq < done")
def _(s, d):
    return _rows(_finished(s, d)).select("visit_id", "record_type", "payload")


@query("st_interrupted", f"WITH {_VALID} SELECT visit_id FROM e WHERE mark LIKE '%false%'")
def _(s, d):
    return I.incomplete(_finished(s, d))


@query("st_late_after_finalize", f"WITH {_VALID} SELECT v.visit_id, count(*) AS late FROM v JOIN e USING (visit_id) WHERE v.seq > done GROUP BY v.visit_id")
def _(s, d):
    return _finished(s, d).filter(F.col("status") == I.LATE).groupBy("visit_id").agg(F.count("*").alias("late"))


@query("st_idle_timeout", f"WITH {_VALID} SELECT visit_id, count(*) AS n FROM v WHERE visit_id NOT IN (SELECT visit_id FROM e) GROUP BY visit_id")
def _(s, d):
    # the stream runs on until the visits that nobody finalised have been idle for the timeout
    out = I.to_table(I.visits(I.valid(records(s, d), TYPES), timeout_ms=1000), "append", folder(s), idle_s=8)
    return out.filter((F.col("status") == "failed") & (F.col("record_type") != I.FINALIZE)).groupBy("visit_id").agg(F.count("*").alias("n"))


@query("st_shutdown_drain", f"WITH {_VALID} SELECT DISTINCT visit_id FROM v WHERE visit_id NOT IN (SELECT visit_id FROM e)")
def _(s, d):
    return I.drain(I.to_table(I.valid(records(s, d), TYPES), "append", folder(s))).select("visit_id")


@query("st_blob_dedup", "SELECT DISTINCT props AS content_hash FROM events")
def _(s, d):
    blobs = events(s, d).select(F.col("props").alias("content_hash"), F.col("ts").alias("received_at"))
    return I.to_table(I.new_blobs(blobs, delay="1000 days"), "append", folder(s)).select("content_hash")


@query("st_cache_limit", "SELECT count(*) AS rows, 3::BIGINT AS batches, 5::BIGINT AS most_files FROM events")
def _(s, d):
    at = folder(s)
    t = table(s, d, "events")
    t.repartition(12).write.parquet(f"{at}/in")  # twelve files, of which five at most are held before they are written out
    stream = I.limited(s, f"{at}/in", t.schema, 5).select("*", F.col("_metadata.file_path").alias("file"))
    q = stream.writeStream.foreachBatch(lambda b, e: b.groupBy("file").count().write.parquet(f"{at}/out/epoch={e}")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    per = s.read.parquet(f"{at}/out").groupBy("epoch").agg(F.count("*").alias("files"), F.sum("count").alias("rows"))
    return per.agg(F.sum("rows").alias("rows"), F.count("*").alias("batches"), F.max("files").alias("most_files"))


@query("st_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    out = I.to_table(I.windows(events(s, d), "ts", "event_type", "value", "1 day"), "complete", folder(s))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("st_sliding_windows", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k AS start FROM events, (VALUES (0), (1)) v(k)) x GROUP BY start")
def _(s, d):
    out = I.to_table(I.windows(events(s, d).withColumn("k", F.lit("all")), "ts", "k", "value", "2 days", "1 day"), "complete", folder(s))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, k")
def _(s, d):
    out = I.to_table(I.sessions(events(s, d), "ts", "user_id", "12 hours"), "complete", folder(s))
    return out.select("user_id", "n", F.col("w.start").cast("timestamp_ntz").alias("start"))


_NOW = 6000  # seconds; a site that has been crawled since before 4200 is late


@query("st_site_queue", f"SELECT user_id AS site_id, CASE WHEN arg_max(event_id % 5, event_id) = 1 AND {_NOW} - max(event_id) > 1800 THEN 4 ELSE arg_max(event_id % 5, event_id) END::INT AS state FROM events GROUP BY user_id")
def _(s, d):
    t = table(s, d, "events").select(F.col("user_id").alias("site_id"), F.timestamp_seconds(F.col("event_id")).alias("at"), (F.col("event_id") % 5).cast("int").alias("state"))
    return I.site_states(t, F.timestamp_seconds(F.lit(_NOW)))


@query("st_site_claim", "SELECT site_id, 1 AS state FROM (SELECT user_id AS site_id, arg_max(event_id % 5, event_id) AS state FROM events GROUP BY user_id) x WHERE state = 0 ORDER BY site_id LIMIT 7")
def _(s, d):
    t = table(s, d, "events").select(F.col("user_id").alias("site_id"), F.timestamp_seconds(F.col("event_id")).alias("at"), (F.col("event_id") % 5).cast("int").alias("state"))
    return I.claim(I.site_states(t, F.timestamp_seconds(F.lit(0))), 7)


@query("st_site_lease")
def _(s, d):
    """Events as transitions of the sites they name: three claimers, each numbering what it sends; checked in tests/test_leases.py."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("wait", "claim", "claim", "done", "renew", "claim", "error"))), (F.col("event_id") % 7 + 1).cast("int"))
    t = events(s, d).select(F.col("user_id").alias("site_id"), kind.alias("event"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("claimer"), F.col("event_id").alias("seq"), F.timestamp_seconds(F.col("event_id")).alias("at"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return I.to_table(leases(t, 1800), "append", folder(s), timers=True)
    finally:
        s.conf.set(store, before)


@query("st_completion_queue", f"WITH {_VALID} SELECT visit_id, mark LIKE '%true%' AS success FROM e")
def _(s, d):
    return I.completed(_finished(s, d))


@query("st_status", "SELECT count(*) AS rows, 0::BIGINT AS running FROM events")
def _(s, d):
    at = folder(s)
    q = events(s, d).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.createDataFrame([(I.rows_done(q), int(q.isActive))], "rows long, running long")
