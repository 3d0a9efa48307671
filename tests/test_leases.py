"""Leases of sites over batches, a restart, and repeated and late transitions."""

import json
import os
import random

import pytest

from tidegauge.streaming import leases as L

SCHEMA = "site_id long, event string, claimer string, seq long, at timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def feed(path, name, rows):
    (path / "in").mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"site_id": s, "event": e, "claimer": c, "seq": n, "at": f"2024-01-01T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z"}) for s, e, c, n, t in rows)
    (path / name).write_text(text)
    os.utime(path / name, (10**9 + int(name.split(".")[0]),) * 2)  # files are read by their age
    (path / name).rename(path / "in" / name)


def run(spark, path, lease_s):
    """Read what is there in batches of a file; a second call goes on from the first one's checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path / "in"))
    q = L.leases(stream, lease_s, "300 seconds").writeStream.outputMode("append").option("checkpointLocation", str(path / "state")).format("parquet").option("path", str(path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(L.OUT_SCHEMA).parquet(str(path / "out")).collect()


def test_two_claimers_and_a_restart(rocks, tmp_path):
    feed(tmp_path, "1.json", [(1, "wait", "q", 1, 0), (1, "claim", "a", 1, 10), (1, "claim", "b", 1, 10), (2, "claim", "a", 1, 11)])
    run(rocks, tmp_path, 100)
    feed(tmp_path, "2.json", [(1, "claim", "b", 2, 50), (1, "claim", "a", 1, 10), (1, "renew", "a", 2, 60), (1, "done", "b", 3, 61)])
    feed(tmp_path, "3.json", [(1, "claim", "b", 4, 200), (1, "done", "a", 3, 205), (2, "wait", "q", 1, 210)])
    feed(tmp_path, "4.json", [(1, "done", "b", 5, 220), (1, "claim", "a", 4, 230), (2, "claim", "b", 1, 231)])
    feed(tmp_path, "5.json", [(3, "wait", "q", 1, 1000)])  # the watermark passes the end of b's lease of site 2
    feed(tmp_path, "6.json", [(3, "claim", "c", 1, 1000)])
    feed(tmp_path, "7.json", [(2, "claim", "a", 2, 1001), (2, "done", "b", 2, 1002)])
    out = {(r.site_id, r.claimer, r.seq, r.event, r.outcome) for r in run(rocks, tmp_path, 100)}
    assert out == {
        (1, "q", 1, "wait", "queued"), (1, "a", 1, "claim", "granted"), (1, "b", 1, "claim", "refused"), (2, "a", 1, "claim", "refused"),
        (1, "b", 2, "claim", "refused"), (1, "a", 1, "claim", "repeated"), (1, "a", 2, "renew", "renewed"), (1, "b", 3, "done", "late"),
        (1, "b", 4, "claim", "granted"), (1, "a", 3, "done", "late"), (2, "q", 1, "wait", "queued"),
        (1, "b", 5, "done", "closed"), (1, "a", 4, "claim", "refused"), (2, "b", 1, "claim", "granted"),
        (3, "q", 1, "wait", "queued"), (3, "c", 1, "claim", "granted"), (2, "b", 0, "timer", "expired"), (2, "a", 2, "claim", "granted"), (2, "b", 2, "done", "late"),
    }


def test_no_site_has_two_holders(rocks, tmp_path):
    """Claimers that race for few sites with repeated deliveries: the leases of a site never overlap, and are numbered without gaps."""
    rng = random.Random(5)
    seq, t, rows = {}, 0, [(s, "wait", "q", 1, 0) for s in range(6)]
    for _ in range(300):
        t += rng.randint(0, 9)
        s, c = rng.randrange(6), rng.choice("abc")
        seq[s, c] = seq.get((s, c), 0) + 1
        rows.append((s, rng.choice(["claim", "claim", "claim", "done", "renew", "wait"]), c, seq[s, c], t))
    again = rng.sample(rows, 40)
    cuts = [0, 80, 160, 240, len(rows)]
    for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        feed(tmp_path, f"{i}.json", rows[x:y] + [r for r in again if r in rows[:y]])
        if i == 1:
            run(rocks, tmp_path, 60)
    out = run(rocks, tmp_path, 60)
    granted = sorted((r for r in out if r.outcome == "granted"), key=lambda r: (r.site_id, r.lease))
    assert len(granted) > 20 and sum(r.outcome == "repeated" for r in out) >= 40
    for a, b in zip(granted, granted[1:], strict=False):
        if a.site_id != b.site_id:
            assert b.lease == 1
            continue
        ends = [r.until_ms for r in out if (r.site_id, r.lease) == (a.site_id, a.lease) and r.outcome in ("granted", "renewed")]
        closed = [r.at_ms for r in out if (r.site_id, r.lease, r.outcome) == (a.site_id, a.lease, "closed")]
        assert b.lease == a.lease + 1 and b.at_ms >= (closed[0] if closed else max(ends))
    assert all(r.claimer in {g.claimer for g in granted if (g.site_id, g.lease) == (r.site_id, r.lease)} for r in out if r.outcome in ("closed", "renewed"))


def test_state_is_read_once_for_each_claimer():
    """A site's rows in a batch cost state calls by their claimers, not by their number."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def exists(self):
            return False

        def update(self, value):
            pass

        def containsKey(self, key):
            self.calls += 1
            return key in self.rows

        def getValue(self, key):
            self.calls += 1
            return self.rows[key]

        def updateValue(self, key, value):
            self.calls += 1
            self.rows[key] = value

    lease = L._Lease(1000)
    lease.site, lease.seen = Held(), Held()
    lease.seen.rows = {("a",): (3,)}
    rows = pd.DataFrame({"at_ms": range(300), "seq": [i // 3 for i in range(300)], "claimer": ["a", "b", "b"] * 100, "event": "done"})
    out = next(lease.handleInputRows((1,), iter([rows]), None))
    assert lease.seen.rows == {("a",): (99,), ("b",): (99,)} and lease.seen.calls <= 6
    assert list(out[out.claimer == "a"].outcome[:5]) == ["repeated"] * 4 + ["late"] and (out[out.claimer == "b"].outcome == "repeated").sum() == 100
