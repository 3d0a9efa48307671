"""Blocks of cookie values against all pairs."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from tidegauge.operators import blocking as B
from tidegauge.operators import identifiers as N


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def texts(seed, n, longest, letters="abcdé01"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("longest", [3, 40, 64, 65, 200])
def test_common_subsequences(longest):
    a, b = texts(1, 12, longest) + ["a" * longest], texts(2, 9, longest) + ["", "a" * longest]
    assert N.common_subsequences(a, b).tolist() == [[lcs(x, y) for y in b] for x in a]


def test_no_like_pair_is_missed():
    a, b = texts(3, 60, 24, "abcd"), texts(4, 50, 24, "abcd")
    like = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() > 0.6}
    found = set(N.may_be_alike(a, b, 0.6))
    assert like and like <= found and len(found) < len(a) * len(b)


def verdicts(values):
    """The kind of the first pair, in order, that fails a test: lengths, likeness, or none."""
    failing = []
    for (_, a), (_, b) in combinations(sorted(values), 2):
        longer = max(len(a), len(b))
        failing.append("lengths" if longer and (not a or not b or abs(len(a) - len(b)) > 0.25 * longer) else "like" if SequenceMatcher(None, a, b).ratio() > 0.6 else None)
    return next((f for f in failing if f), None)


@pytest.mark.parametrize("block", [500, 3])
def test_flags(spark, monkeypatch, block):
    monkeypatch.setattr(B, "PAIR_BLOCK", block)
    rng = random.Random(7)
    rows = []
    for c in range(40):
        kind = c % 4
        for k in range(rng.randint(1, 12)):
            v = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12 if kind else rng.randint(8, 12)))
            v = rng.choice(["", None, "same", v]) if kind == 3 and rng.random() < 0.3 else v
            rows.append((f"c{c}", f"s{c % 3}", v, f"p{k % 3}"))
        if kind == 2:
            rows.append((f"c{c}", f"s{c % 3}", rows[-1][2][:-1] + "#", "p9"))
    df = spark.createDataFrame(rows, "name string, top_level_etld string, value string, browser_id string")
    held = {}
    for n, s, v, p in rows:
        held.setdefault((n, s), []).append((p, v or ""))
    first = {k: verdicts(v) for k, v in held.items()}
    many = {k: len(v) > 1 for k, v in held.items()}
    want = {k: (many[k] and first[k] is None, many[k] and first[k] != "lengths", many[k] and first[k] != "like", many[k]) for k in held}
    assert len(set(want.values())) == 4
    got = {(r.name, r.site): (r.hold_id, r.unique_ok, r.similarity_ok, r.passed_checkin) for r in B.hold_id_faithful(df).collect()}
    assert got == want
    assert {(r.name, r.top_level_etld): r.hold_id for r in B.hold_id(df).collect()} == {k: v[0] for k, v in want.items()}
    assert B.hold_id_faithful(df.limit(0)).count() == B.hold_id(df.limit(0)).count() == 0


def test_first_values_meet_the_others_first(spark, monkeypatch):
    """Every two blocks used to be compared, though a pair of a first value decides."""
    monkeypatch.setattr(B, "HEADS", ((3, 8), (5, 4)))
    monkeypatch.setattr(B, "PAIR_BLOCK", 4)
    met = []
    monkeypatch.setattr(B, "_block_pairs", lambda v, which, f=B._block_pairs: (met.append(v.select("name").distinct().count()), f(v, which))[1])
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)) for _ in range(n)]
    held = {c: [(f"p{i % 2}{i:02d}", v) for i, v in enumerate(fresh(25))] for c in ("first", "second", "late", "none", "twice", "few")}
    for c, i in (("first", 1), ("second", 4), ("late", 20)):  # ranks by profile
        rows = sorted(held[c])
        held[c] = [*rows[:-1], (rows[-1][0], rows[i][1])]
    held["twice"] += [max(held["twice"])]
    held["few"] = held["few"][:3]
    rows = [(c, "s", v, p) for c, x in held.items() for p, v in x]
    df = spark.createDataFrame(rows, "name string, top_level_etld string, value string, browser_id string")
    want = {c: verdicts(x) for c, x in held.items()}
    got = {r.name: (r.hold_id, r.unique_ok, r.similarity_ok) for r in B.hold_id_faithful(df).collect()}
    assert got == {c: (f is None, f != "lengths", f != "like") for c, f in want.items()}
    assert met == [3, 3]  # late, none and twice are compared in full
