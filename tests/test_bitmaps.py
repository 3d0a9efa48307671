"""Itemsets on bitmaps against plain counts."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tidegauge.operators import bitmaps as M
from tidegauge.operators import itemsets as I


def plain(rows, least, most):
    held = {}
    for b, x in rows:
        if b is not None and x is not None:
            held.setdefault(b, set()).add(x)
    n = Counter(c for h in held.values() for k in range(1, most + 1) for c in combinations(sorted(h), k))
    return {c: v for c, v in n.items() if v >= least}


def baskets(seed, n=300):
    """Some items go together nearly always, one is in every basket, one basket holds all, some rows stand twice."""
    rng = random.Random(seed)
    rows = [(i, x) for i in range(n) for x in "abcdefghij" if rng.random() < 0.12 + 0.05 * (ord(x) % 5)]
    rows += [(i, x) for i in range(0, n, 3) for x in "pqrs" if rng.random() < 0.95] + [(i, "all") for i in range(n)]
    return rows + [(7, x) for x in "abcdefghijpqrs"] + rows[:40] + [(None, "a"), (5, None)]


@pytest.mark.parametrize(("size", "least", "most"), [(1 << 15, 20, 4), (40, 20, 4), (40, 6, 3), (25, 60, 6), (40, 1000, 3), (40, 20, 1)])
def test_against_plain_counts(spark, monkeypatch, size, least, most):
    monkeypatch.setattr(M, "RANGE", size)
    monkeypatch.setattr(M, "SETS", 50)
    rows = baskets(least)
    got = M.eclat(spark.createDataFrame(rows, "b long, x string"), "b", "x", least, most).collect()
    assert {tuple(r["items"]): r.n for r in got} == plain(rows, least, most) and len(got) == len({tuple(r["items"]) for r in got})


def test_numbers_as_items_and_no_rows(spark):
    rows = [(b, x) for b, x in (("u", 3), ("u", 20), ("v", 3), ("v", 20), ("w", 100))]
    df = spark.createDataFrame(rows, "b string, x long")
    assert {tuple(r["items"]): r.n for r in M.eclat(df, "b", "x", 2, 3).collect()} == {(3,): 2, (20,): 2, (3, 20): 2}
    assert M.eclat(df.limit(0), "b", "x", 1, 3).count() == 0


def test_supports_of_given_sets(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 50)
    rows = baskets(3)
    every = plain(rows, 1, 3)
    sets = random.Random(1).sample(sorted(every), 60) + [("a", "zzz"), ("none",)]
    df = spark.createDataFrame(rows, "b long, x string")
    got = M.supports(M.prepared(df, "b", "x"), spark.createDataFrame([(list(s),) for s in sets + sets[:3]], "items array<string>"), 6)
    assert {tuple(r["items"]): r.n for r in got.collect()} == {s: every.get(s, 0) for s in sets}


def test_long_itemsets_by_the_same_way(spark):
    rows = baskets(5, 120)
    got = I.fp_growth(spark.createDataFrame(rows, "b long, x string"), "b", "x", 0.25, 7).collect()
    assert {tuple(r["items"]): r.n for r in got} == plain(rows, 30, 7)
    assert max(len(r["items"]) for r in got) >= 5
