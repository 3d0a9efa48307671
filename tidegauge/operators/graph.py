"""Metrics of the bipartite graph of clusters and cookies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.overview import r6
from tidegauge.plans.checkpoints import cut
from tidegauge.plans.skew import BROADCAST_ROWS, components
from tidegauge.plans.views import select, view
from tidegauge.registry import query


def basic(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Nodes of both sides, edges, mean degree, density, and edges that lack a side (they are left out of the others)."""
    good = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()
    bad = edges.filter(F.col(left).isNull() | F.col(right).isNull()).agg(F.count("*").alias("bad_edges"))
    one = good.agg(F.countDistinct(left).alias("n_left"), F.countDistinct(right).alias("n_right"), F.count("*").alias("n_edges"))
    nodes = F.col("n_left") + F.col("n_right")
    return one.crossJoin(bad).select("*", r6(2 * F.col("n_edges") / nodes).alias("mean_degree"), r6(2 * F.col("n_edges") / (nodes * (nodes - 1))).alias("density"))


def degrees(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(side, node, degree) of every node."""
    d = lambda side, c: edges.groupBy(F.lit(side).alias("side"), F.col(c).cast("string").alias("node")).agg(F.count("*").alias("degree"))
    return d("left", left).unionByName(d("right", right))


def graph_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of both sides; nodes are ``l:`` and ``r:`` with their names."""
    e = edges.select(F.concat(F.lit("l:"), F.col(left).cast("string")).alias("a"), F.concat(F.lit("r:"), F.col(right).cast("string")).alias("b")).distinct()
    return components(e)


def projection(edges: DataFrame, basket: str, item: str) -> DataFrame:
    """(a, b, weight): items by the number of baskets they share."""
    e = edges.select(basket, item).distinct()
    return e.withColumnRenamed(item, "a").join(e.withColumnRenamed(item, "b"), basket).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def hits(edges: DataFrame, left: str, right: str, rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """(side, node, score): hubs and authorities, each side's scores summing to 1; stops early when they settle.

    Each round is two joins on the edges; scores are one row per node and are checkpointed every fifth round, which is when they
    are made to sum to 1: until then they grow by less than the edges' number a round, which a double holds.
    """
    e = cut(edges.select(left, right).distinct())
    hub = e.select(left).distinct().withColumn("h", F.lit(1.0))
    last = None
    for i in range(rounds):
        auth = e.join(hub, left).groupBy(right).agg(F.sum("h").alias("a"))
        hub = e.join(auth, right).groupBy(left).agg(F.sum("a").alias("h"))
        if i % 5 == 4 or i == rounds - 1:
            new = cut(hub)  # the sum reads the scores, it doesn't find them again
            hub = new.crossJoin(F.broadcast(new.agg(F.sum("h").alias("t")))).select(left, (F.col("h") / F.col("t")).alias("h"))
            if last is not None and (hub.join(last.withColumnRenamed("h", "g"), left).agg(F.sum(F.abs(F.col("h") - F.col("g")))).first()[0] or 0) < tolerance:
                break
            last = hub
    auth = e.join(hub, left).groupBy(right).agg(F.sum("h").alias("a"))
    auth = auth.crossJoin(F.broadcast(auth.agg(F.sum("a").alias("t")))).select(F.lit("right").alias("side"), F.col(right).cast("string").alias("node"), (F.col("a") / F.col("t")).alias("score"))
    return hub.select(F.lit("left").alias("side"), F.col(left).cast("string").alias("node"), F.col("h").alias("score")).unionByName(auth)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) from weighted edges (a, b, weight), cheaper than modularity clustering (:func:`louvain`).

    All nodes take the label with the largest weight among their neighbours and themselves at once (ties to
    the smaller label), until nothing changes or the rounds are over.
    """
    turned = F.inline(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    rows = edges.select(turned)
    both = cut(rows.union(rows.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both.b == labels.node).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.col("w")).alias("top"))
        new = cut(votes.join(best, "a").filter("w = top").groupBy("a").agg(F.min("community").alias("community")).withColumnRenamed("a", "node"))
        moved = new.join(labels.withColumnRenamed("community", "before"), "node").filter("community <> before").isEmpty()
        labels = new
        if moved:
            break
    return labels


def _hint(n: int):
    """A broadcast of tables with a row for each of n nodes, while those are few (counted)."""
    return F.broadcast if n <= BROADCAST_ROWS else lambda df: df


def modularity(both: DataFrame, labels: DataFrame, total: float, nodes: int | None = None) -> float:
    """Modularity of communities (node, community) for edges in both directions (a, b, weight) whose weights sum to ``total``."""
    few = _hint(labels.count() if nodes is None else nodes)
    named = both.join(few(labels.toDF("a", "ca")), "a").join(few(labels.toDF("b", "cb")), "b")
    per = named.groupBy("ca").agg(F.sum("weight").alias("out"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("own"))
    return per.agg(F.sum(F.col("own") / total - (F.col("out") / total) * (F.col("out") / total))).first()[0] or 0.0


def _local_moves(both: DataFrame, total: float, rounds: int, least: float = 1e-5, start: DataFrame | None = None, inside: DataFrame | None = None, polish: bool = False) -> DataFrame:
    """(node, community) after moves to neighbouring communities while the modularity grows, from a community for each node or from ``start``.

    With ``inside`` (node, part) moves stay inside the parts: only links within a part lead to a community. With ``polish``
    a round that doesn't raise the modularity is tried again with the moves only that are the best of both communities they
    touch: those touch different ones, so their gains add up.

    In each round the half of the nodes that a hash picks moves at once, each to the community of the largest gain, so
    two nodes seldom chase each other; two rounds in turn that don't raise the modularity by ``least`` are the end.
    """
    degree = cut(both.groupBy("a").agg(F.sum("weight").alias("k")))
    n = degree.count()
    few = _hint(n)
    labels = degree.select(F.col("a").alias("node"), F.col("a").alias("community")) if start is None else start
    open_ = both.filter("a <> b")
    if inside is not None:
        open_ = cut(open_.join(few(inside.toDF("a", "_pa")), "a").join(few(inside.toDF("b", "_pb")), "b").filter("_pa = _pb").select("a", "b", "weight"))
    best, idle = modularity(both, labels, total, n), 0
    for r in range(rounds):
        own = labels.join(few(degree.withColumnRenamed("a", "node")), "node").toDF("a", "at", "k")
        sums = own.groupBy(F.col("at").alias("to")).agg(F.sum("k").alias("all"))
        links = open_.join(few(labels.toDF("b", "to")), "b").groupBy("a", "to").agg(F.sum("weight").alias("w"))
        turn = F.pmod(F.xxhash64("a", F.lit(r // 2)) + r, F.lit(2)) == 0
        to = links.join(few(own.filter(turn)), "a").join(few(sums), "to")
        # weight to the community less what chance would give, the node itself left out; the own community counts 0 where no link leads into it
        value = F.col("w") - F.col("k") * (F.col("all") - F.when(F.col("to") == F.col("at"), F.col("k")).otherwise(0.0)) / total
        there = F.col("to") == F.col("at")
        rated = to.withColumn("value", F.round(value, 9)).groupBy("a").agg(F.max(F.when(~there, F.struct("value", "to"))).alias("m"), F.max(F.when(there, F.col("value"))).alias("stay"))
        moved = rated.filter(F.col("m.value") > F.coalesce("stay", F.lit(0.0))).select(F.col("a").alias("node"), F.col("m.to").alias("new"), (F.col("m.value") - F.coalesce("stay", F.lit(0.0))).alias("gain"))
        moved = cut(moved) if polish else moved
        apply = lambda moves: cut(labels.join(few(moves.select("node", "new")), "node", "left").select("node", F.coalesce("new", "community").alias("community")))  # noqa: E731, B023
        new = apply(moved)
        q = modularity(both, new, total, n)
        if polish and q <= best + least and not moved.isEmpty():
            touched = moved.join(few(labels), "node").select("node", "new", F.struct("gain", "node").alias("g"), F.explode(F.array("community", "new")).alias("c"))
            kept = touched.join(few(touched.groupBy("c").agg(F.max("g").alias("g"))), ["c", "g"]).groupBy("node", "new").agg(F.count("*").alias("_n")).filter("_n = 2")
            new = apply(cut(kept))
            q = modularity(both, new, total, n)
        if q > best + least:
            labels, best, idle = new, q, 0
        else:
            idle += 1
            if idle == 2:
                break
    return labels


def louvain(edges: DataFrame, rounds: int = 12, passes: int = 8) -> DataFrame:
    """(node, community) by modularity from weighted edges (a, b, weight): local moves, then the communities become nodes, until nothing merges.

    A community is named by its smallest node. Moves are made for many nodes at once, so results differ from those of
    the sequential method; like it, this never lowers the modularity.
    """
    turned = F.inline(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    both = cut(edges.select("a", "b", F.col("weight").cast("double").alias("weight")).select(turned).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    total = both.agg(F.sum("weight")).first()[0] or 0.0
    named = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(passes if total else 0):
        labels = _local_moves(both, total, rounds)
        if labels.filter("node <> community").isEmpty():
            break
        names = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = cut(labels.join(names, "community").select("node", F.col("name").alias("community")))
        named = cut(named.join(labels.toDF("community", "next"), "community").select("node", F.col("next").alias("community")))
        both = cut(both.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
    names = named.groupBy("community").agg(F.min("node").alias("name"))
    return named.join(names, "community").select("node", F.col("name").alias("community"))


def connected_parts(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, community) with every community (node, community) split into its connected parts, named by their smallest nodes."""
    within = both.filter("a <> b").join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").filter("ca = cb").select("a", "b")
    return labels.join(components(within), "node", "left").select("node", F.coalesce("root", "node").alias("community"))


def leiden(edges: DataFrame, rounds: int = 12, passes: int = 8) -> DataFrame:
    """(node, community) like :func:`louvain`, with a refinement: every community is connected.

    After the moves each community is begun anew from its single nodes, which move inside it only, and the connected parts that
    come of that are the nodes of the next pass; these start in the communities of the moves. So what was put together too
    early can part again. Splitting a community into its connected parts never lowers the modularity.
    """
    turned = F.inline(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    whole = cut(edges.select("a", "b", F.col("weight").cast("double").alias("weight")).select(turned).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    both, start = whole, None
    total = both.agg(F.sum("weight")).first()[0] or 0.0
    named = cut(both.select(F.col("a").alias("node")).distinct().withColumn("part", F.col("node")).withColumn("community", F.col("node")))
    best = -1.0
    for _ in range(passes if total else 0):
        labels = cut(connected_parts(both, _local_moves(both, total, rounds, start=start, polish=True)))
        q = modularity(both, labels, total)
        if q <= best + 1e-6:
            break
        best = q
        named = cut(named.select("node", "part").join(labels.toDF("part", "community"), "part"))
        parts = cut(connected_parts(both, _local_moves(both, total, rounds, inside=labels, polish=True)).toDF("node", "part"))
        if parts.filter("node <> part").isEmpty():
            break
        named = cut(named.withColumnRenamed("part", "_old").join(parts.toDF("_old", "part"), "_old").select("node", "part", "community"))
        both = cut(both.join(parts.toDF("a", "pa"), "a").join(parts.toDF("b", "pb"), "b").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("weight").alias("weight")))
        start = cut(parts.join(labels, "node").groupBy(F.col("part").alias("node")).agg(F.min("community").alias("community")))
    return connected_parts(whole, named.select("node", "community"))


def twins(both: DataFrame) -> DataFrame:
    """(v, c): each node of edges in both directions (v, w) with the smallest of the nodes that have just its neighbours.

    Neighbourhoods are alike when their sizes and the sums of two hashes of their nodes agree.
    """
    total = lambda *seed: F.sum(F.xxhash64("w", *(F.lit(x) for x in seed)).cast("decimal(38,0)"))
    around = cut(both.groupBy("v").agg(F.count("*").alias("k"), total().alias("x"), total(7).alias("y")))
    return around.join(around.groupBy("k", "x", "y").agg(F.min("v").alias("c")), ["k", "x", "y"]).select("v", "c")


def betweenness(edges: DataFrame, left: str, right: str, k: int = 2000, seed: int = 42) -> DataFrame:
    """(node, score): betweenness from k sampled sources (all, where there are no more), by Brandes' accumulation in breadth-first rounds.

    Nodes with the same neighbours (:func:`twins`) lie alike to every other node, so the rounds run over classes of them: a class counts
    with the number of its members, and one run serves all sources of a class, whose other members are two steps from the source.
    All sources go one step further in each round: paths are counted per source and node, and the dependencies come back
    level by level. There is a row for each class of sources and class that it reaches, and every level is a checkpoint.
    """
    l, r = F.concat(F.lit("l:"), F.col(left).cast("string")), F.concat(F.lit("r:"), F.col(right).cast("string"))
    e = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(l.alias("v"), r.alias("w")).distinct()
    e = cut(e.select(F.inline(F.array(F.struct("v", "w"), F.struct(F.col("w").alias("v"), F.col("v").alias("w"))))))
    nodes = cut(twins(e))
    n = nodes.count()
    sampled = cut(nodes.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), "v").cast("binary"))).limit(k))
    sources = cut(sampled.groupBy(F.col("c").alias("s")).agg(F.count("*").cast("double").alias("drawn")))
    sizes = cut(nodes.groupBy(F.col("c").alias("v")).agg(F.count("*").cast("double").alias("size")))
    # of twins the first one has all the edges of their class
    e = e.join(sizes.select("v"), "v", "left_semi").join(sizes.select(F.col("v").alias("w")), "w", "left_semi")
    e = cut(e.join(sizes.select(F.col("v").alias("w"), F.col("size").alias("w_size")), "w"))
    # a source is a row of its own (one), apart from its twins; ``size`` has the members of the class at this level
    levels = [cut(sources.select("s", F.col("s").alias("v"), F.lit(True).alias("one"), F.lit(1.0).alias("paths"), F.lit(1.0).alias("size")))]
    used = sampled.count()
    while True:
        near = levels[-1].join(e, "v").groupBy("s", F.col("w").alias("v"), "w_size").agg(F.sum(F.col("paths") * F.col("size")).alias("paths"))
        near = near.select("s", "v", F.lit(False).alias("one"), "paths", (F.col("w_size") - (F.col("s") == F.col("v")).cast("double")).alias("size")).filter("size > 0")
        for before in levels[-2:]:  # a neighbour is at most one level nearer
            near = near.join(before.select("s", "v", "one"), ["s", "v", "one"], "left_anti")
        near = cut(near)
        if near.isEmpty():
            break
        levels.append(near)
    scores, share = [], levels[-1].withColumn("share", F.lit(0.0))
    for nearer in reversed(levels[:-1]):
        scores.append(share)
        back = share.select("s", F.col("v").alias("w"), (F.col("size") * (F.col("share") + 1) / F.col("paths")).alias("part")).join(e.select("v", "w"), "w").groupBy("s", "v").agg(F.sum("part").alias("part"))
        share = cut(nearer.join(back, ["s", "v"], "left").select("s", "v", "one", "paths", "size", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
    scale = n / ((n - 1) * (n - 2) * used) if n > 2 and used else 1.0
    if not scores:
        return nodes.select(F.col("v").alias("node"), F.lit(0.0).alias("score"))
    parts = reduce(DataFrame.unionByName, scores).join(sources, "s")
    # of a source's class each member counts for the sources other than itself
    total = parts.groupBy(F.col("v").alias("c")).agg(F.sum(F.col("share") * F.col("drawn")).alias("share"), F.sum(F.when(F.col("s") == F.col("v"), F.col("share")).otherwise(0.0)).alias("own"))
    all_ = nodes.join(total, "c", "left").join(sampled.select("v", F.lit(1.0).alias("_drawn")), "v", "left")
    score = F.coalesce("share", F.lit(0.0)) - F.when(F.col("_drawn").isNotNull(), F.coalesce("own", F.lit(0.0))).otherwise(0.0)
    return all_.select(F.col("v").alias("node"), (score * scale).alias("score"))


_EDGES = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem"


def _edges(s, d):
    return select(s, d, _EDGES)


@query("gr_basic", f"WITH e AS ({_EDGES}), x AS (SELECT count(DISTINCT s) AS n_left, count(DISTINCT p) AS n_right, count(*) AS n_edges FROM e) SELECT *, 0::BIGINT AS bad_edges, round(2 * n_edges / (n_left + n_right), 6)::DOUBLE AS mean_degree, round(2 * n_edges / ((n_left + n_right) * (n_left + n_right - 1)), 6)::DOUBLE AS density FROM x")
def _(s, d):
    return basic(_edges(s, d), "s", "p")


@query("gr_degree", f"WITH e AS ({_EDGES}) SELECT 'left' AS side, s::VARCHAR AS node, count(*) AS degree FROM e GROUP BY s UNION ALL SELECT 'right', p::VARCHAR, count(*) FROM e GROUP BY p")
def _(s, d):
    return degrees(_edges(s, d), "s", "p")


@query("gr_degree_histogram", f"WITH e AS ({_EDGES}) SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM e GROUP BY p) x GROUP BY degree")
def _(s, d):
    return degrees(_edges(s, d), "s", "p").filter("side = 'right'").groupBy("degree").agg(F.count("*").alias("n"))


# Suppliers and parts of single orders: a graph of many components.
_SPARSE = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber = 7"


@query(
    "gr_components",
    f"""WITH RECURSIVE e AS (SELECT 'l:' || s AS x, 'r:' || p AS y FROM ({_SPARSE}) z), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x) SELECT x AS node, min(y) AS root FROM r GROUP BY x""",
)
def _(s, d):
    return graph_components(select(s, d, _SPARSE), "s", "p")


@query("gr_projection", "SELECT a.cookie AS a, b.cookie AS b, count(*) AS weight FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie GROUP BY ALL")
def _(s, d):
    return projection(view(s, d, "bk"), "cluster_id", "cookie")


@query("gr_hits")
def _(s, d):
    return hits(_edges(s, d), "s", "p").select("side", "node", F.round("score", 6).alias("score"))


@query("gr_louvain")
def _(s, d):
    return louvain(projection(view(s, d, "bk"), "cluster_id", "cookie"))


@query("gr_label_propagation")
def _(s, d):
    return label_propagation(projection(view(s, d, "bk"), "cluster_id", "cookie"))


@query("gr_betweenness_sampled")
def _(s, d):
    return betweenness(view(s, d, "mem").select("cluster", "cookie_name").distinct(), "cluster", "cookie_name")
