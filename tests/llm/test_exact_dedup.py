import hashlib
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, docs

from tidegauge.llm import exact_dedup as E


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 1000, 5000):
        keys = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        disp, slots = E.build_mph(keys)
        assert sorted(slots) == list(range(n))
        if n:
            assert (E.find_slots(disp, n, keys) == slots).all()
            other = rng.integers(0, 256, (500, 32), dtype=np.uint8)
            at = E.find_slots(disp, n, other)
            assert ((0 <= at) & (at < n)).all()  # nonmembers get a slot too, so bytes must be compared


def test_report(spark):
    rows = ODD + [(i, f"text {i % 17}") for i in range(100, 300)] + [(i, "hot") for i in range(1000, 1200)]
    out = E.dedup_report(docs(spark, rows)).collect()
    ids, n = defaultdict(list), Counter()
    for i, t in rows:
        ids[t or ""].append(i)
        n[t or ""] += 1
    best = {t: max((i for i in v if i is not None), default=None) for t, v in ids.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, best[t or ""], n[t or ""], sha(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter({sha(t): 1 for t in ids})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert {r.known for r in out} == {True, False}


def test_history_and_nonmembers(spark):
    old = E.digests(docs(spark, [(1, "a"), (2, "b"), (9, "b")]))
    new = E.digests(docs(spark, [(5, "b"), (20, "a"), (6, "c"), (7, "c")]))
    got = {(r.keep_id, r.n, r.known) for r in E.groups(new, old).collect()}
    assert got == {(20, 2, True), (9, 3, True), (7, 2, False)}
    assert {(r.keep_id, r.n, r.known) for r in E.groups(new, old.limit(0)).collect()} == {(5, 1, False), (20, 1, False), (7, 2, False)}


def test_small_history_beside_a_large_batch(spark):
    """The batch is dealt over as many shards as it needs, whatever the history holds."""
    new = E.digests(docs(spark, [(i, f"t{i % 900}") for i in range(1000)]))
    for old in ([(5000, "t1"), (5001, "other")], []):
        history = E.digests(docs(spark, old))
        got = {r.keep_id: (r.n, r.known) for r in E.groups(new, history, shard_keys=100).collect()}
        assert len(got) == 900 + bool(old) and sum(n for n, _ in got.values()) == 1000 + len(old)
        assert {i for i, (_, k) in got.items() if k} == ({5000, 5001} if old else set())
        shards = E._winners(new, 10).groupBy("shard").count().collect()
        assert len(shards) == 10 and max(r["count"] for r in shards) < 200


def test_dedup_keeps_columns(spark):
    df = docs(spark, ODD + [(50, "x"), (51, "x")])
    out = E.dedup(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[3, "a"] == 1 and got[51, "x"] == 1 and (50, "x") not in got
    assert len({(r or "") for (_, r) in got}) == sum(got.values())
    assert E.dedup(df.limit(0)).count() == 0 and E.dedup_report(df.limit(0)).count() == 0
