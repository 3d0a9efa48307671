import gzip
import sqlite3
import struct
import subprocess
import sys
import time
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import readers as R
from tidegauge.sources import writers as W

ROOT = str(Path(__file__).resolve().parents[1])


def test_sqlite_tables(spark, tmp_path):
    for site in range(3):
        db = sqlite3.connect(tmp_path / f"{site}.sqlite")
        if site < 2:
            db.execute("CREATE TABLE site_visits (visit_id INTEGER, site_url TEXT)")
            db.executemany("INSERT INTO site_visits VALUES (?, ?)", [(site * 10 + i, f"http://s{site}/") for i in range(5)] + [(None, None)])
        db.commit()
        db.close()
    df = R.sqlite_tables(spark, str(tmp_path), "site_visits", "visit_id long, site_url string, site_rank long")
    rows = df.collect()
    assert len(rows) == 12 and {r.site_rank for r in rows} == {None} and {r.visit_id for r in rows} == {None, *range(5), *range(10, 15)}
    assert R.sqlite_tables(spark, str(tmp_path), "site_visits", "visit_id long, site_url string", visit_id=11).count() == 1


def test_blobs_are_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "aa.zip").write_bytes(gzip.compress(b"one"))
    (tmp_path / "in" / "bb.zip").write_bytes(b"two")
    b = R.blobs(spark, str(tmp_path / "in"))
    assert {(r.content_hash, bytes(r.content)) for r in b.collect()} == {("aa", b"one"), ("bb", b"two")}
    W.blobs(b.filter("content_hash = 'aa'"), str(tmp_path / "out"))
    W.blobs(b, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    df = spark.range(1000).withColumn("name", F.concat(F.lit("n"), "id"))
    W.jdbc(df, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = R.jdbc(spark, url, "t", partition=("id", 0, 1000, 4), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.count() == 1000 and back.rdd.getNumPartitions() == 4


def test_rules_hosts_and_listing(spark, tmp_path):
    (tmp_path / "easylist.txt").write_text("! c\n\n||a.com^\n  b  \n")
    (tmp_path / "easyprivacy.txt").write_text("x$y\n")
    assert {tuple(r) for r in R.rules_text(spark, str(tmp_path)).collect()} == {("easylist", "||a.com^"), ("easylist", "b"), ("easyprivacy", "x$y")}
    (tmp_path / "hosts").mkdir()
    (tmp_path / "hosts" / "h").write_text("# x\n0.0.0.0 Ads.com # y\n127.0.0.1\n\n0.0.0.0  b.org\n")
    assert {r.domain for r in R.hosts_file(spark, str(tmp_path / "hosts")).collect()} == {"ads.com", "b.org"}
    folders = spark.createDataFrame([("hosts",), ("empty",)], "folder string")
    assert {(r.folder, r.files) for r in R.listing(spark, str(tmp_path), folders).collect()} == {("hosts", 1), ("empty", 0)}


def test_nested_results(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"results": [{"url": "u1", "blocked": true}, {"other": 1}]}, {"x": 2}]')
    assert [tuple(r) for r in R.nested_results(spark, str(tmp_path), "url string, blocked boolean").collect()] == [("u1", True)]


def test_profiles_and_flags(spark):
    df = spark.createDataFrame([("a_EU1.csv", "1"), ("xUS2y", "false"), ("US2", None)], "f string, flag string")
    assert [r[0] for r in df.select(R.profile_of_file(F.col("f"))).collect()] in ([None, None, "US2"], ["EU1", None, "US2"])
    assert [r.flag for r in R.flags(df, "flag").collect()] == [True, False, None]


def test_batches_fall_back_to_rows(spark):
    def send(batch):
        if any(r["id"] == 7 for r in batch):
            raise OSError("no")

    bad = W.in_batches(spark.range(20), send, rows=5, tries=2, wait=0).collect()
    assert [(r.record, r.error) for r in bad] == [('{"id": 7}', "OSError: no")]


@pytest.mark.parametrize("buckets", [0, 4])
def test_tables(spark, buckets):
    W.table(spark.range(50), "tg_test", ["id"], buckets)
    assert spark.table("tg_test").count() == 50 and W.size_of(spark.table("tg_test")) > 0
    spark.sql("DROP TABLE tg_test")


def number(n):
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def block(pairs, restart=16):
    out, starts, last = bytearray(), [], b""
    for i, (k, v) in enumerate(pairs):
        same = 0
        if i % restart == 0:
            starts.append(len(out))
        else:
            while same < min(len(k), len(last)) and k[same] == last[same]:
                same += 1
        out += number(same) + number(len(k) - same) + number(len(v)) + k[same:] + v
        last = k
    return bytes(out) + struct.pack(f"<{len(starts)}II", *starts, len(starts))


def literal(data):
    """Snappy with literals, and a copy where the block ends in a run."""
    run = len(data) - len(data.rstrip(data[-1:]))
    head = data[: len(data) - run + 1]
    out = number(len(data))
    for i in range(0, len(head), 1000):
        part = head[i : i + 1000]
        out += bytes([61 << 2]) + struct.pack("<H", len(part) - 1) + part
    left = run - 1
    while left:
        n = min(left, 64)
        out += bytes([(n - 1) << 2 | 2, 1, 0])
        left -= n
    return out


def sorted_table(entries, compress, per=40):
    """A table file of (key, seq, live, value)."""
    out, index = bytearray(), []
    keyed = [(k + struct.pack("<Q", seq << 8 | live), v) for k, seq, live, v in sorted(entries, key=lambda e: (e[0], -e[1]))]

    def add(raw):
        data = literal(raw) if compress else raw
        at = len(out)
        out.extend(data + bytes([compress]) + b"\0\0\0\0")
        return number(at) + number(len(data))

    for i in range(0, len(keyed), per):
        index.append((keyed[min(i + per, len(keyed)) - 1][0], add(block(keyed[i : i + per]))))
    meta, top = add(block([])), add(block(index, 1))
    return bytes(out) + (meta + top).ljust(40, b"\0") + bytes.fromhex("57fb808b247547db")


def write_log(batches):
    out = bytearray()
    for seq, writes in batches:
        data = struct.pack("<QI", seq, len(writes)) + b"".join(bytes([v is not None]) + number(len(k)) + k + (number(len(v)) + v if v is not None else b"") for k, v in writes)
        first = True
        while True:
            left = 32768 - len(out) % 32768
            if left < 7:
                out.extend(b"\0" * left)
                left = 32768
            part, data = data[: left - 7], data[left - 7 :]
            out.extend(b"\0\0\0\0" + struct.pack("<HB", len(part), (1 if not data else 2) if first else (4 if not data else 3)) + part)
            first = False
            if not data:
                break
    return bytes(out)


@pytest.mark.parametrize("compress", [0, 1])
def test_leveldb(spark, tmp_path, compress):
    (tmp_path / "s").mkdir()
    old = [(f"h{i:03}".encode(), i + 1, 1, f"old {i} ".encode() * 20 + b"z" * (i % 150)) for i in range(200)]
    new = [(f"h{i:03}".encode(), 1000 + i, 1, b"") for i in range(0, 200, 3)] + [(f"h{i:03}".encode(), 2000 + i, 0, b"") for i in range(0, 200, 7)]
    (tmp_path / "s" / "000005.ldb").write_bytes(sorted_table(old, compress))
    (tmp_path / "s" / "000007.sst").write_bytes(sorted_table(new, compress))
    big = bytes(range(256)) * 400
    (tmp_path / "s" / "000009.log").write_bytes(write_log([(5000, [(b"h000", big), (b"h001", None)]), (5002, [(b"new", b"x")])]) + b"\0\0\0\0\xff\x7f\x01torn")
    (tmp_path / "s" / "MANIFEST-000004").write_bytes(b"?")
    want = {k: v for k, _, _, v in old}
    for k, _, live, v in sorted(new, key=lambda e: e[1]):
        want.pop(k, None)
        if live:
            want[k] = v
    want[b"h000"], want[b"new"] = big, b"x"
    want.pop(b"h001")
    got = {bytes(r.key): bytes(r.value) for r in R.leveldb(spark, str(tmp_path / "s")).collect()}
    assert got == want
    assert R.leveldb_content(spark, str(tmp_path / "s")).filter("content_hash = 'new'").count() == 1


def test_public_suffixes(spark, tmp_path):
    from tidegauge.functions import url as U

    (tmp_path / "list.dat").write_text("// ===BEGIN===\n\ncom\nco.uk  trailing words\n*.ck\n!www.ck\nuk\n")
    rules = R.public_suffixes(spark, str(tmp_path / "list.dat"))
    assert {r.rule for r in rules.collect()} == {"com", "co.uk", "*.ck", "!www.ck", "uk"}
    hosts = ["a.b.com", "x.y.co.uk", "co.uk", "a.b.c.ck", "www.ck", "x.www.ck", "one.uk", "h.other", "com"]
    got = {r.h: r.domain for r in U.registrable_domain(spark.createDataFrame([(h,) for h in hosts], "h string"), "h", rules).collect()}
    assert got == {"a.b.com": "b.com", "x.y.co.uk": "y.co.uk", "co.uk": None, "a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "one.uk": "one.uk", "h.other": "h.other", "com": None}


def test_dbapi_is_shared_by_all_executors(tmp_path):
    """Two executors, each a process of its own, write to and read from one database."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import sqlite3, sys
from functools import partial
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
from tidegauge.sources import readers as R, writers as W
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/ck").config("spark.sql.warehouse.dir", "{tmp_path}/wh").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("BULK", e.queries()["sink_rdbms_bulk"](s, "/root/testdata/sf0.001").distinct().count(), s.read.parquet("/root/testdata/sf0.001/customer.parquet").count())
print("CURSOR", e.queries()["src_cursor_batched"](s, "/root/testdata/sf0.001").agg(dict(n="sum")).first()[0])
connect = partial(sqlite3.connect, "{tmp_path}/db.sqlite", timeout=60)
connect().executescript("CREATE TABLE t (id INTEGER, name TEXT); CREATE TABLE t_parts (run TEXT, part INTEGER, PRIMARY KEY (run, part))")
W.dbapi(s.sql("SELECT nullif(id, 5) AS id, 'x' AS name FROM range(0, 1000, 1, 6)"), connect, "t", batch=30)
back = R.dbapi(s, connect, "t", "id long, name string", partition=("id", 4), fetch=7)
print("BACK", back.count(), back.distinct().count(), back.filter("id IS NULL").count(), back.rdd.getNumPartitions())
""")
    said = subprocess.run([sys.executable, "-B", str(script)], capture_output=True, text=True, timeout=240, check=False, cwd=tmp_path)
    lines = dict(x.split(" ", 1) for x in said.stdout.splitlines() if x.startswith(("BULK", "CURSOR", "BACK")))
    n = lines["BULK"].split()[1]
    assert lines == {"BULK": f"{n} {n}", "CURSOR": n, "BACK": "1000 1000 1 4"}, said.stderr[-2000:]


def test_dbapi_transactions(spark, tmp_path):
    connect = partial(sqlite3.connect, str(tmp_path / "db.sqlite"), timeout=60)
    connect().executescript("CREATE TABLE t (id INTEGER); CREATE TABLE t_parts (run TEXT, part INTEGER, PRIMARY KEY (run, part))")
    assert R.dbapi(spark, connect, "t", "id long", partition=("id", 4)).count() == 0
    with pytest.raises(Exception, match="no such table"):
        W.dbapi(spark.range(10), connect, "absent")
    W.dbapi(spark.range(0, 100, 1, 3), connect, "t", batch=9)
    assert R.dbapi(spark, connect, "t", "id long", fetch=8).distinct().count() == 100 == connect().execute("SELECT count(*) FROM t").fetchone()[0]
    assert connect().execute("SELECT count(*) FROM t_parts").fetchone()[0] == 3


def test_in_batches_waits_between_tries_only(spark):
    """Rows that are refused for good cost no wait after their last try."""

    def send(batch):
        raise ValueError("refused")

    began = time.monotonic()
    assert W.in_batches(spark.range(0, 40, 1, 1), send, rows=20, tries=2, wait=1.0).count() == 40
    assert time.monotonic() - began < 30  # 42 waits of a second
