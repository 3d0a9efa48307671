"""The exact similarity join of sets against all pairs."""

import random

import numpy as np
import pytest
from test_minhash import families, plain

from tidegauge.operators import set_join as J
from tidegauge.operators import simhash


@pytest.mark.parametrize(("least", "hot"), [(0.5, 4000), (0.8, 4000), (0.8, 7)])
def test_all_pairs_of_sets(spark, least, hot):
    rows = families(3, 600)
    want = plain(rows, least)
    got = [((r.a, r.b), r.jaccard) for r in J.set_pairs(spark.createDataFrame(rows, "k long, s array<string>"), "k", "s", least, hot).collect()]
    assert len(got) == len(want) > 100 and all(abs(j - want[p]) < 1e-9 for p, j in got)


def test_every_pair_of_copies(spark):
    rows = [(i, [f"w{j}" for j in range(20 + i % 3)]) for i in range(60)] + [(100 + i, ["x", None, "x"]) for i in range(3)] + [(200, None), (201, [])]
    held = [(k, frozenset(x for x in s or () if x)) for k, s in rows]
    want = {(a, b) for i, (a, s) in enumerate(held) for b, t in held[i + 1 :] if s and t and len(s & t) >= 0.8 * len(s | t)}
    got = [(r.a, r.b) for r in simhash.jaccard_pairs(spark.createDataFrame(rows, "k long, s array<string>"), "k", "s", 0.8).collect()]
    assert sorted(got) == sorted(want)
    none = spark.createDataFrame([], "k long, s array<string>")
    assert simhash.jaccard_pairs(none, "k", "s", 0.8).count() == 0


def test_candidates_of_common_tokens_are_few(spark):
    """Sets that share tokens but aren't alike are told apart before they are pairs, whatever they share."""
    rng = random.Random(5)
    rows = [(i, [f"c{j}" for j in rng.sample(range(300), 60)]) for i in range(700)]
    df = J.cut(J.distinct_sets(spark.createDataFrame(rows, "k long, s array<string>"), "k", "s"))
    assert J.candidates(df, 0.8).count() < 50


def test_sketches_never_differ_in_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(2)
    for n, gone in ((20, 3), (500, 90), (3000, 400)):
        h = rng.integers(-(2**62), 2**62, n + gone, dtype=np.int64)
        for bits in (128, J.width(n)):
            a, b = (np.frombuffer(J.sketch(x, bits), dtype=np.uint64) for x in (h[:n], h[gone:]))
            assert np.bitwise_count(a ^ b).sum() <= 2 * gone
    assert J.width(1) == J.width(128) == 128 and J.width(129) == 256


def test_a_point_stands_for_its_copies(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}
    weight = {i: rng.choice([1, 1, 2, 5]) for i in range(40)}
    copies = [(i, 100 * i + c) for i in range(40) for c in range(weight[i])]
    every = [(x, y) for i, x in copies for j, y in copies if x < y and (i == j or tuple(sorted((i, j))) in pairs)]
    df = spark.createDataFrame
    want = {r.k: r.cluster for r in simhash.dbscan(df(every, "a long, b long"), df([(x,) for _, x in copies], "k long"), "k", 5).collect()}
    got = {r.k: r.cluster for r in simhash.dbscan(df([(100 * a, 100 * b) for a, b in pairs], "a long, b long"), df([(100 * i, w) for i, w in weight.items()], "k long, w long"), "k", 5, "w").collect()}
    assert {x: got[100 * i] for i, x in copies} == want and len(set(want.values())) > 2


def test_a_set_is_sent_once_to_each_block_it_may_meet(spark):
    """Whatever its tokens and however many share them; small blocks and few keys at once change nothing."""
    rows = families(7, 400)
    want = plain(rows, 0.8)
    sets = J.cut(J.distinct_sets(spark.createDataFrame(rows, "k long, s array<string>"), "k", "s"))
    h = J.hashed(sets)
    sizes = {r.n: r["count"] for r in sets.groupBy("n").count().collect()}
    where, meets = J.plan(sizes, 0.8, 3)
    assert max(parts for _, parts in where.values()) > 1
    sent = h.mapInArrow(J._sending(where, meets, 0.8, J.prefix_keys(J.bucket_counts(h), 0.8)), J.ROWS.format("long"))
    per = {r.rep: r["count"] for r in sent.groupBy("rep").count().collect()}
    assert sent.distinct().count() == sent.count() and set(per) == {r.rep for r in sets.collect()}
    assert max(per.values()) <= max(len(m) for m in meets) < len(meets)
    found = J.meeting(h, sets, 0.8, J.prefix_keys(J.bucket_counts(h), 0.8), hot=3, entries=50)
    assert {(r.a, r.b): r.jaccard for r in J.verified(found, sets, 0.8).collect()} == pytest.approx(want)
