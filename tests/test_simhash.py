"""Fingerprints by a table of grams against gram by gram, and clusters of near hashes against all pairs."""

import hashlib
import random
import re

import numpy as np

from tidegauge.operators import near_links as L
from tidegauge.operators import simhash as S


def plain(text):
    c = re.sub(r"[^a-z0-9]", "", re.sub(r"[^a-zA-Z0-9\s]", "", text).lower())
    hs = [int.from_bytes(hashlib.md5(c[i : i + 3].encode()).digest()[8:], "big") for i in range(max(len(c) - 2, 1))]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return out - (1 << 64) if out >> 63 else out


def test_print_of():
    rng = random.Random(5)
    texts = ["", "-", "a", "Z9", "aB3", "\x85\xa0é", "aaa" * 400, "KKİk ssß", *("".join(rng.choices("abcXYZ019 .,\n\té€", k=rng.choice((5, 300, 4000)))) for _ in range(30))]
    assert [S.print_of(t.encode()) for t in texts] == [plain(t) for t in texts]


def test_no_gram_is_hashed_for_each_text(monkeypatch):
    """A long text used to hash each of its different grams."""
    S._gram_bits()
    monkeypatch.setattr(S, "md5", None)
    assert S.print_of(b"the quick brown fox") == plain("the quick brown fox")


def dense(n, seed):
    """Hashes within few bits of three bases, each with thousands of near pairs."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(3)]
    out = {rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(0, 64, 4), rng.randint(0, 4))) for _ in range(n)} | {rng.getrandbits(64) for _ in range(50)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in out)


def roots(hashes, k):
    u = np.array(hashes).view(np.uint64)
    label = np.arange(len(u))
    L.join(label, *np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= k))
    return label


def test_forest_joins_what_all_pairs_join(monkeypatch):
    hashes = np.array(dense(1500, 7))
    for few, crowded in ((48, 1 << 16), (2, 1 << 16), (2, 30)):
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "CROWDED", crowded)
        for k, m in ((2, 3), (2, 4), (1, 3), (3, 5)):
            label = np.arange(len(hashes))
            for c, mask in S._choices(k, m)[1]:
                order = np.argsort(hashes & mask, kind="stable")
                v = (hashes & mask)[order]
                a, b = L.forest(np.cumsum(np.r_[False, v[1:] != v[:-1]]), [S.free_bits(k, m)[c]], np.zeros(len(v), dtype=int), hashes[order], k)
                assert len(a) < len(hashes)
                L.join(label, np.searchsorted(hashes, a), np.searchsorted(hashes, b))
            assert (label == roots(hashes, k)).all(), (few, crowded, k, m)


def test_many_bits_are_compared_in_blocks(spark, monkeypatch):
    """Pieces for 8 bits of like hashes made more pairs than there are, several times each."""
    hashes = dense(900, 11)
    df = spark.createDataFrame([(f"k{i:04}", h) for i, h in enumerate(hashes)] + [("a", hashes[5])], "k string, simhash long")
    name = {h: f"k{i:04}" for i, h in enumerate(hashes)} | {hashes[5]: "a"}
    monkeypatch.setattr(S, "_pairs_by_pieces", None)
    monkeypatch.setattr(S, "LEAST_BLOCK", 200)
    got = [tuple(r) for r in S.near_pairs(df, "k", 8).collect()]
    want = {(x, y, d, name[x], name[y]) for i, x in enumerate(hashes) for y in hashes[i + 1 :] if (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= 8}
    assert len(got) == len(want) > 20_000 and set(got) == want
    assert S.near_pairs(df.limit(0), "k", 8).count() == 0


def test_pairs_by_either_plan(spark):
    hashes = dense(300, 12)
    df = spark.createDataFrame(list(enumerate(hashes)), "rep long, simhash long")
    for k, m in ((2, 4), (8, 10)):
        assert sorted(map(tuple, S._pairs_by_blocks(df, k, 300).collect())) == sorted(map(tuple, S._pairs_by_pieces(df, k, m).collect()))
    spread = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 4096)
    assert S.plan_pairs(spread, 1_000_000, 2) and S.plan_pairs(np.array(hashes), 1_000_000, 8) is None


def test_clusters_make_no_pairs(spark, monkeypatch):
    """Pairs grow with the square of like hashes; clusters used to join all of them."""
    monkeypatch.setattr(S, "near_pairs", None)
    hashes = dense(800, 9)
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)] + [(i + 5000, h) for i, h in enumerate(hashes[:20])], "k long, simhash long")
    want = roots(hashes, 2).tolist()
    assert {r.k: r.cluster for r in S.clusters(df, "k", 2).collect()} == {**dict(enumerate(want)), **{i + 5000: want[i] for i in range(20)}}
    assert S.near_links(df, 2).count() <= len(hashes) * 20
    assert S.clusters(df.limit(0), "k", 2).count() == 0


def test_rows_of_a_hash_do_not_grow_with_the_hashes(spark, monkeypatch):
    """Blocks are as large as memory allows, so that a hash is sent to few; tiles of a block lose no pair."""
    assert S.block_count(3_000_000) == S.block_count(300_000) == S.BLOCKS
    rng = np.random.default_rng(4)
    hashes = [int(x) for x in np.unique(rng.integers(0, 1 << 12, 500))]
    df = spark.createDataFrame([(h, i) for i, h in enumerate(hashes)], "simhash long, rep long")
    want = sorted((a, b) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= 3)
    monkeypatch.setattr(S, "TILE", 64)
    for least in (S.LEAST_BLOCK, 100):
        monkeypatch.setattr(S, "LEAST_BLOCK", least)
        assert sorted((r.ha, r.hb) for r in S._pairs_by_blocks(df, 3, len(hashes)).collect()) == want
