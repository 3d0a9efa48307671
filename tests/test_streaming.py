import json
import time

from tidegauge.streaming import ingest as I

SCHEMA = "seq long, record_type string, visit_id long, payload string"


def feed(path, name, rows):
    (path / "tmp").mkdir(exist_ok=True)
    (path / "in").mkdir(exist_ok=True)
    f = path / "tmp" / name
    f.write_text("\n".join(json.dumps(dict(zip(["seq", "record_type", "visit_id", "payload"], r, strict=True))) for r in rows))
    f.rename(path / "in" / name)


def test_visits_over_batches(spark, tmp_path):
    feed(tmp_path, "1.json", [(1, "a", 1, "{}"), (2, "a", 2, "{}"), (3, "finalize", 1, "{}"), (4, "a", 1, '{"late": 1}'), (5, "b", None, "{}"), (6, "zzz", 1, "{}"), (7, "a", 2, "junk")])
    feed(tmp_path, "2.json", [(8, "b", 2, "{}"), (9, "finalize", 2, '{"success": false}'), (10, "a", 1, '{"late": 2}'), (11, "finalize", 1, "{}")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = I.to_table(I.visits(I.valid(stream, ["a", "b"])), "append", str(tmp_path / "out1"), timers=True)
    assert sorted((r.visit_id, r.record_type, r.status) for r in out.collect()) == [(1, "a", "complete"), (1, "a", "late"), (1, "a", "late"), (1, "finalize", "complete"), (1, "finalize", "late"), (2, "a", "incomplete"), (2, "b", "incomplete"), (2, "finalize", "incomplete")]
    assert {tuple(r) for r in I.completed(out).collect()} == {(1, True), (2, False)} and [r.visit_id for r in I.incomplete(out).collect()] == [2]
    bad = I.to_table(I.dead_letters(stream, ["a", "b"]), "append", str(tmp_path / "out2")).collect()
    assert sorted((r.seq, r.reason) for r in bad) == [(5, "no visit_id"), (6, "unknown type"), (7, "payload")]


def test_long_visits_come_out_in_frames(spark, tmp_path, monkeypatch):
    feed(tmp_path, "1.json", [(i, "a", 1, f'{{"i": {i}}}') for i in range(25_000)])
    feed(tmp_path, "2.json", [(30_000, "finalize", 1, "{}")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = I.to_table(I.visits(stream), "append", str(tmp_path / "out"), timers=True)
    assert out.filter("record_type = 'a' and status = 'complete'").select("payload").distinct().count() == 25_000


def test_idle_visits_are_closed_for_good(spark, tmp_path):
    """An idle visit fails once; what comes for it later is late and doesn't open it again."""
    status = I.Status()
    spark.streams.addListener(status)
    feed(tmp_path, "1.json", [(1, "a", 5, "{}"), (2, "a", 6, "{}"), (3, "finalize", 6, "{}")])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    q = I.visits(stream, timeout_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="300 milliseconds").start()

    def wait(rows):
        for _ in range(120):
            if spark.table("idle").filter("visit_id = 5").count() >= rows:
                return
            time.sleep(0.5)

    try:
        wait(2)  # no new data is needed for a timer to fire
        assert {(r.record_type, r.status) for r in spark.table("idle").filter("visit_id = 5").collect()} == {("a", "failed"), ("finalize", "failed")}
        feed(tmp_path, "2.json", [(4, "b", 5, "{}"), (5, "finalize", 5, "{}")])
        wait(4)
        time.sleep(2)
        assert sorted((r.record_type, r.status) for r in spark.table("idle").filter("visit_id = 5").collect()) == [("a", "failed"), ("b", "late"), ("finalize", "failed"), ("finalize", "late")]
    finally:
        q.stop()
        spark.streams.removeListener(status)
    assert status.batches > 0 and status.rows >= 5


def test_site_states(spark):
    from pyspark.sql import functions as F

    rows = [(1, 100, 0), (1, 200, 1), (2, 100, 1), (2, 150, 2), (3, 1900, 1), (4, 5, 0), (5, 6, 0)]
    t = spark.createDataFrame(rows, "site_id long, at long, state int").withColumn("at", F.timestamp_seconds("at"))
    states = I.site_states(t, F.timestamp_seconds(F.lit(2001)))
    assert {r.site_id: r.state for r in states.collect()} == {1: 4, 2: 2, 3: 1, 4: 0, 5: 0}
    assert [tuple(r) for r in I.claim(states, 1).collect()] == [(4, 1)]


def test_timers_fire_however_long_a_batch_takes(spark, tmp_path):
    """A first batch that takes longer than the idle time: the stream goes on until the timers have fired."""

    def slowly(it):
        import time

        time.sleep(4)
        yield from it

    spark.createDataFrame([("a", 5, "{}", 1), ("b", 6, "{}", 2)], "record_type string, visit_id long, payload string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_type string, visit_id long, payload string, seq long").parquet(str(tmp_path / "in")).mapInPandas(slowly, "record_type string, visit_id long, payload string, seq long")
    out = I.to_table(I.visits(stream, timeout_ms=300), "append", str(tmp_path / "out"), idle_s=2)
    assert sorted((r.visit_id, r.record_type, r.status) for r in out.collect()) == [(5, "a", "failed"), (5, "finalize", "failed"), (6, "b", "failed"), (6, "finalize", "failed")]


def test_held_records_come_out_one_by_one():
    """A closed visit is written while its state is read, whatever its length."""
    from pyspark.sql import Row

    read = []

    class State:
        exists = staticmethod(lambda: True)
        clear = staticmethod(lambda: None)

        def get(self):
            for i in range(25_000):
                read.append(i)
                yield ("a", str(i))

    visit = I._Visits(1, 1)
    visit.held, visit.closed = State(), State()
    out = visit._close(7, [], True, "complete")
    assert next(out) == Row(visit_id=7, record_type="a", payload="0", status="complete") and len(read) == 1


def test_every_visit_that_nobody_finalises_goes_idle(spark, tmp_path):
    """Whatever the visit's number: the query reads its whole table."""
    from datetime import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    rows = [(i, i, "click", datetime(2024, 1, i), "{}") for i in range(1, 12)] + [(12, 1, "error", datetime(2024, 1, 1, 0, 0, 1), "{}")]
    columns = [pa.array(x) for x in zip(*rows, strict=True)]
    pq.write_table(pa.table(columns, names=["event_id", "user_id", "event_type", "ts", "props"]), tmp_path / "events.parquet")
    got = entry.queries()["st_idle_timeout"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(101 * i, 1) for i in range(2, 12)]
