"""The stored index against a plain dictionary, and kept clusters against clusters found anew."""

import random
import re

from tidegauge.operators import near_index as N
from tidegauge.plans.skew import components

BASES = [random.Random(1).getrandbits(64) for _ in range(25)]


def hashes(rng, n):
    """Hashes near a few bases, so that many are within a few bits of each other."""
    out = []
    for _ in range(n):
        h = rng.choice(BASES)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def df(spark, rows):
    return spark.createDataFrame(rows, "key string, simhash long")


def near(held, probes, k):
    return {(p, x, d) for p, h in probes for x, g in held.items() if (d := bin((h ^ g) & (1 << 64) - 1).count("1")) <= k}


def test_additions_deletions_and_look_ups(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{i}", h) for i, h in enumerate(hashes(rng, 60))]
    held = dict(rows)
    index = N.NearIndex.create(df(spark, rows), str(tmp_path / "x"), "key", 3, buckets=8)
    probes = [(f"p{i}", h) for i, h in enumerate(hashes(rng, 15))] + [("same", rows[0][1])]

    def same(k=3):
        got = {(r.probe, r.key, r.distance) for r in N.NearIndex.open(spark, str(tmp_path / "x")).look_up(df(spark, probes), "key", k).collect()}
        assert got == near(held, probes, k)

    same()
    more = [(f"k{i}", h) for i, h in zip([0, 5, 70, 71], hashes(rng, 4), strict=True)]  # two known keys, two new
    index.add(df(spark, more), "key")
    held |= dict(more)
    same()
    index.delete(df(spark, [("k0", 0), ("k7", 0), ("k70", 0), ("unknown", 0)]).select("key"), "key")
    for k in ("k0", "k7", "k70"):
        del held[k]
    same()
    index.add(df(spark, [("k0", probes[0][1])]), "key")  # back again
    held["k0"] = probes[0][1]
    same(1)
    assert {(r.key, r.simhash) for r in index.live().collect()} == set(held.items())
    before = index.generations()
    index.compact()
    assert len(before) == 4 and len(index.generations()) == 1
    same()
    index.delete(df(spark, rows).select("key"), "key")
    held = {k: h for k, h in held.items() if k not in dict(rows)}
    same()
    sizes = index.bucket_sizes().collect()
    assert sum(r.largest >= 1 for r in sizes) == len(sizes) > 0


def test_look_ups_read_their_buckets_only(spark, tmp_path):
    rows = [(f"k{i}", h) for i, h in enumerate(hashes(random.Random(3), 200))]
    index = N.NearIndex.create(df(spark, rows), str(tmp_path / "x"), "key", 1, buckets=32, pieces=2)
    asked = N.piece_keys(df(spark, rows[:1]), 1, 2).withColumn("bucket", N._bucket(32, "choice", "v"))
    read = index._read("pieces", asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    touched = {r[0] for r in read.select("bucket").distinct().collect()}
    assert len(touched) <= 2 and len({r[0] for r in index._read("pieces", None).select("bucket").distinct().collect()}) > 10


def test_an_index_without_entries(spark, tmp_path):
    index = N.NearIndex.create(df(spark, []), str(tmp_path / "x"), "key", 2, buckets=4)
    assert index.look_up(df(spark, [("p", 1)]), "key").count() == 0
    index.add(df(spark, [("a", 1), ("a", 3)]), "key")  # a key named twice
    assert [(r.key, r.simhash) for r in index.live().collect()] == [("a", 3)]


def test_kept_clusters(spark):
    """After each of ten additions and deletions the labels are those of a full run."""
    rng = random.Random(4)
    edges, labels, nodes = set(), spark.createDataFrame([], "node long, root long"), set()
    for step in range(10):
        if step % 3 == 2:
            gone = set(rng.sample(sorted(edges), min(len(edges), 6)))
            edges -= gone
            labels = N.unlink(labels, spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame(sorted(gone), "a long, b long"))
        else:
            new = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(7)}
            edges |= new
            nodes |= {x for e in new for x in e}
            labels = N.link(labels, spark.createDataFrame(sorted(new), "a long, b long"))
        labels = N.cut(labels)
        full = {r.node: r.root for r in components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        got = {r.node: r.root for r in labels.collect()}
        assert got == {x: full.get(x, x) for x in nodes}


def dense(n, seed):
    """Different hashes of which most are within two bits of many others."""
    rng = random.Random(seed)
    out = {BASES[rng.randrange(3)] ^ sum(1 << b for b in rng.sample([*range(0, 60, 5), 63], rng.randint(0, 3))) for _ in range(n)} | {rng.getrandbits(64) for _ in range(20)}
    return [h - (1 << 64) if h >> 63 else h for h in sorted(out)]


def test_counts_of_near_entries_make_no_pairs(spark, tmp_path, monkeypatch):
    """How many entries are near, the least distance and the smallest key: as by all pairs, which used to be made."""
    hs = dense(500, 6)
    rows = [(f"k{i:04}", h) for i, h in enumerate(hs[::2])] + [(f"c{i}", hs[0]) for i in range(9)] + [(f"d{i}", hs[2]) for i in range(3)]
    index = N.NearIndex.create(df(spark, rows), str(tmp_path / "x"), "key", 2, buckets=4)
    index.delete(df(spark, rows[5:60:3]).select("key"), "key")
    held = {k: h for k, h in rows if k not in {k for k, _ in rows[5:60:3]}}
    probes = [(f"p{i}", h) for i, h in enumerate(hs)] + [("again", hs[0])]
    monkeypatch.setattr(N.NearIndex, "look_up", None)
    for k in (0, 1, 2):
        want = {}
        for p, x, d in near(held, probes, k):
            n, least, first = want.get(p, (0, 9, "z"))
            want[p] = (n + 1, min(least, d), min(first, x))
        got = index.near_counts(df(spark, probes), "key", k).collect()
        assert len(got) == len(want) and {r.probe: (r.n, r.nearest, r.first_key) for r in got} == want
    assert index.near_counts(df(spark, []), "key").count() == 0


def test_clusters_are_kept_without_edges(spark, tmp_path):
    """Hashes put in and taken out: the labels are those of all near pairs, and links are no more than rows of buckets."""

    def clusters(hashes):
        root = {h: h for h in hashes}
        for h in sorted(hashes):
            if root[h] == h:
                todo = [h]
                while todo:
                    x = todo.pop()
                    for y in hashes:
                        if root[y] > h and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                            root[y] = h
                            todo.append(y)
        return root

    hs = dense(350, 8)
    rng = random.Random(9)
    rng.shuffle(hs)
    rows = [(f"k{i}", h) for i, h in enumerate(hs)]
    old, new, stale = rows[40:], rows[:30], rows[30:40]
    index = N.NearIndex.create(df(spark, old + stale), str(tmp_path / "x"), "key", 2, buckets=4)
    index.delete(df(spark, stale).select("key"), "key")  # their hashes stay among the pieces, and link nothing
    labels = N.cut(N.components(N.near_links(df(spark, old), 2)))
    index.add(df(spark, new), "key")
    links = N.cut(index.new_links(df(spark, new)))
    assert links.count() <= len(hs) * len(N.free_bits(2, index.pieces))
    labels = N.cut(N.link(labels, links))
    want = clusters([h for _, h in old + new])
    assert {r.node: r.root for r in labels.collect()}.items() <= want.items() and all(h == r for h, r in want.items() if h not in {x.node for x in labels.collect()})
    gone = rng.sample(old + new, 60)
    labels = N.without(labels, df(spark, gone).selectExpr("simhash AS node"), 2)
    want = clusters([h for _, h in set(old + new) - set(gone)])
    got = {r.node: r.root for r in labels.collect()}
    assert got.items() <= want.items() and all(h == r for h, r in want.items() if h not in got)
