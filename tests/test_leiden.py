"""Communities by modularity with refinement: connected, and as good as the best partition of small graphs."""

import random

import pytest

from tidegauge.operators import graph as G
from tidegauge.plans.skew import components


def score(edges, named):
    """Modularity by its definition."""
    total = 2 * sum(w for _, _, w in edges)
    degree, inner = {}, 0.0
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        inner += 2 * w * (named[a] == named[b])
    out = {}
    for x, k in degree.items():
        out[named[x]] = out.get(named[x], 0) + k
    return inner / total - sum((k / total) ** 2 for k in out.values())


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [items[0], *part], *rest[i + 1 :]]


def run(spark, edges):
    return {r.node: r.community for r in G.leiden(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}


def assert_connected(spark, edges, named):
    inner = [(a, b) for a, b, _ in edges if named[a] == named[b]]
    root = {r.node: r.root for r in components(spark.createDataFrame(inner, "a string, b string")).collect()} if inner else {}
    for c in set(named.values()):
        assert len({root.get(x, x) for x, n in named.items() if n == c}) == 1 and c == min(x for x, n in named.items() if n == c)


@pytest.mark.parametrize("seed", [1])
def test_small_graphs(spark, seed):
    """Against all partitions of eight nodes."""
    rng = random.Random(seed)
    nodes = "abcdefgh"
    edges = [(x, y, 1.0) for i, x in enumerate(nodes) for y in nodes[i + 1 :] if rng.random() < (0.8 if nodes.index(x) // 4 == nodes.index(y) // 4 else 0.15)]
    named = run(spark, edges)
    held = sorted(named)
    best = max(score(edges, {x: i for i, p in enumerate(ps) for x in p}) for ps in partitions(held))
    assert score(edges, named) >= best - 0.05
    assert_connected(spark, edges, named)


def test_connected_parts(spark):
    edges = [("a", "b", 1.0), ("c", "d", 1.0), ("b", "x", 1.0)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a string, b string, weight double")
    labels = spark.createDataFrame([(n, "one") for n in "abcd"] + [("x", "two")], "node string, community string")
    assert {r.node: r.community for r in G.connected_parts(both, labels).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"}
