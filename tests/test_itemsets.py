"""Itemsets and contrasts of several items against plain counts."""

from collections import Counter
from itertools import combinations
from math import comb, log2

from tidegauge.operators import itemsets as I
from tidegauge.operators import load_all
from tidegauge.registry import QUERIES

load_all()
BASKETS = [(i, c) for i in range(40) for c in "abcde" if (i * 7 + ord(c) * (1 + i % 3)) % 5 < 3]


def counts(rows, depth=3):
    held = {}
    for b, c in rows:
        held.setdefault(b, set()).add(c)
    return len(held), Counter(x for h in held.values() for k in range(1, depth + 1) for x in combinations(sorted(h), k))


def fisher(a, n1, b, n2):
    p = [comb(n1, x) * comb(n2, a + b - x) / comb(n1 + n2, a + b) for x in range(max(0, a + b - n2), min(a + b, n1) + 1)]
    return min(1.0, sum(x for x in p if x <= p[a - max(0, a + b - n2)] * (1 + 1e-7)))


def test_deep_queries(spark, monkeypatch):
    rows = [(b, c) for b, c in BASKETS]
    pos, neg = [r for r in rows if r[0] % 2], [r for r in rows if r[0] % 2 == 0]
    df = lambda x: spark.createDataFrame(x, "cluster_id long, cookie string")
    monkeypatch.setattr(I, "_classes", lambda s, d: (df(pos), df(neg)))
    monkeypatch.setattr(I, "view", lambda s, d, name: df(rows))
    (n1, p), (n2, q) = counts(pos), counts(neg)
    out = QUERIES["fp_contrast_table_deep"](spark, "").collect()
    assert len(out) == len(set(p) | set(q)) and {r.length for r in out} == {1, 2, 3}
    many = Counter()
    for r in out:
        key = tuple(x[4:] for x in r.itemset.split(" & "))
        a, b = p[key], q[key]
        lift = log2((a / n1 + 1e-6) / (b / n2 + 1e-6))
        assert (r.count_pos, r.count_neg) == (a, b)
        assert abs(r.p_value - fisher(a, n1, b, n2)) < 1e-6 and abs(r.log2_lift - lift) < 1e-6
        if fisher(a, n1, b, n2) < 0.05 and abs(lift) > 0.05:
            many[len(key)] += 1
    assert {r.length: r.n for r in QUERIES["fp_significant_count_deep"](spark, "").collect()} == dict(many)
    n, every = counts(rows)
    assert {tuple(r["items"]): r.n for r in QUERIES["fp_growth_deep"](spark, "").collect()} == {k: v for k, v in every.items() if v >= 0.02 * n}


def test_fisher_of_large_tables():
    """The work doesn't grow with the counts: exact on all small tables, and near the normal law on tables of a billion."""
    from itertools import product
    from math import erfc, sqrt

    for p, q, r, s in product(range(7), range(7), range(7), (0, 1, 5, 9)):
        if p + q and r + s:
            assert abs(I.fisher_p(p, q, r, s) - fisher(p, p + q, r, r + s)) < 1e-9
    n = 10**9
    for away in (0, 20_000, 40_000):
        p, r = n // 4 + away, n // 4
        z = away / sqrt(2 * n * (p + r) / (2 * n) * (1 - (p + r) / (2 * n)))
        assert abs(I.fisher_p(p, n - p, r, n - r) - erfc(z / sqrt(2))) < 1e-2
    assert I.fisher_p(n // 2, n // 2, n // 4, 3 * n // 4) == 0.0
