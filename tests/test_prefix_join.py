"""The sorted prefix join against every prefix of every value."""

import random

import pytest

from tidegauge.operators.prefix_join import prefixes_of


def plain(values, prefixes, every):
    held = {p for p in prefixes if p is not None}
    out = set()
    for v in set(values):
        own = [v[:n] for n in range(len(v) + 1) if v[:n] in held] if v is not None else []
        out |= {(v, p) for p in own} if every else {(v, own[-1] if own else None)}
    return out


def got(spark, values, prefixes, every, ranges):
    v = spark.createDataFrame([(x,) for x in values], "v string").repartition(4)
    p = spark.createDataFrame([(x,) for x in prefixes], "p string").repartition(3)
    rows = [(r.v, r.p) for r in prefixes_of(v, "v", p, "p", every, ranges).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("every", [False, True])
def test_random_texts(spark, ranges, every):
    rng = random.Random(ranges)
    word = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, n)))
    values = [word(9) for _ in range(2000)] + [None, None, "", "a" * 50]
    prefixes = [word(6) for _ in range(150)] + [None] + (["", "a" * 20, "a" * 20] if ranges != 3 else [])
    assert got(spark, values, prefixes, every, ranges) == plain(values, prefixes, every)


def test_a_hundred_thousand_prefixes_of_five_hundred_lengths(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdefghij") for _ in range(520)) for _ in range(260)]
    prefixes = list({s[: rng.randint(1, 500)] for s in stems for _ in range(900)})
    assert len(prefixes) > 90_000 and len({len(p) for p in prefixes}) == 500
    values = [s[: rng.randint(1, 520)] + rng.choice(["", "z", "zz"]) for s in stems for _ in range(8)] + ["hot"] * 5000
    assert got(spark, values, prefixes, False, 16) == plain(values, prefixes, False)


def test_empty_sides(spark):
    assert got(spark, [], ["a"], False, 3) == set()
    assert got(spark, ["ab", None], [], False, 3) == {("ab", None), (None, None)}
    assert got(spark, ["ab", None], [], True, 3) == set()


def test_one_shuffle_a_side(spark):
    """The plan before the merge deals both sides out once, by range."""
    v, p = (spark.createDataFrame([(x,) for x in "abc"], f"{c} string") for c in "vp")
    seen = []
    import tidegauge.operators.prefix_join as P

    cut = P.cut
    try:
        P.cut = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
        prefixes_of(v, "v", p, "p").collect()
    finally:
        P.cut = cut
    assert len(seen) == 1 and seen[0].count("Exchange rangepartitioning") == seen[0].count("Exchange ") == 1
