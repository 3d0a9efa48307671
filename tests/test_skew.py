import random

from tidegauge.plans import skew


def test_skew_join(spark):
    many = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(5000)], "k long, v long")
    one = spark.createDataFrame([(i, f"x{i}") for i in range(0, 5000, 2)], "k long, w string")
    want = {(0 if i % 3 else i, i, f"x{0 if i % 3 else i}") for i in range(5000) if i % 3 or i % 2 == 0}
    for hot in (10, 100_000):
        out = skew.skew_join(many, one, ["k"], 5000, hot=hot)
        assert out.columns == ["k", "v", "w"]
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_sized_join(spark):
    rows = [(0 if i % 3 else i, i) for i in range(5000)]
    size = {k: sum(x == k for x, _ in rows) for k in {0, 3, 6}}
    many = spark.createDataFrame([(k, v, size.get(k, 1)) for k, v in rows], "k long, v long, n long")
    one = spark.createDataFrame([(i, f"x{i}", size.get(i, 1)) for i in range(0, 5000, 2)], "k long, w string, n long")
    out = skew.sized_join(many, one, ["k"], "n", hot=10)
    assert out.columns == ["k", "v", "w"]
    got = [tuple(r) for r in out.collect()]
    want = {(k, v, f"x{k}") for k, v in rows if k % 2 == 0}
    assert len(got) == len(want) and set(got) == want


def test_components_with_a_hub(spark):
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000 + r.randrange(60), 9000 + r.randrange(60)) for _ in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in skew.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}


def test_the_estimated_size_does_not_grow_with_the_rounds(spark):
    """The planner multiplies the sizes of joined sides; kept over rounds, that is a number of 4^rounds digits in the driver."""
    found = skew.components(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 100
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(301)}
