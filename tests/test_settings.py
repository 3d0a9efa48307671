"""Queries run with the operators' own settings."""

import inspect

from tidegauge.operators import graph, load_all, simhash
from tidegauge.registry import QUERIES

load_all()


def test_no_reduced_settings(monkeypatch):
    class Seen(Exception):
        pass

    for module, name, query, want in ((graph, "betweenness", "gr_betweenness_sampled", {"k": 2000}), (graph, "hits", "gr_hits", {"rounds": 200, "tolerance": 1e-8}), (simhash, "minhash", "mh_signature", {"n": 128})):
        shape = inspect.signature(getattr(module, name))

        def spy(*args, **kwargs):
            held = shape.bind(*args, **kwargs)
            held.apply_defaults()
            raise Seen(held.arguments)

        class Any:
            def __getattr__(self, n):
                return lambda *a, **k: self

        monkeypatch.setattr(module, name, spy)
        for helper in ("view", "table", "_edges", "_tokens"):
            if hasattr(module, helper):
                monkeypatch.setattr(module, helper, lambda *a, **k: Any())
        try:
            QUERIES[query](Any(), "")
            raise AssertionError(query)
        except Seen as e:
            assert {k: e.args[0][k] for k in want} == want


def test_hits_sums_the_scores_every_fifth_round_only(spark, monkeypatch):
    """The sum of every round used to take the joins of the round twice."""
    edges = spark.createDataFrame([(i, j) for i in range(6) for j in range(i % 3 + 1)], "s long, p long")
    sums = []
    monkeypatch.setattr(graph.F, "broadcast", lambda df, f=graph.F.broadcast: (sums.append(1), f(df))[1])
    got = graph.hits(edges, "s", "p", rounds=10, tolerance=0.0).collect()
    assert len(sums) == 3
    for side in ("left", "right"):
        assert abs(sum(r.score for r in got if r.side == side) - 1) < 1e-12
