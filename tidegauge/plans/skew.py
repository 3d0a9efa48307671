"""Joins whose keys may hold any share of the rows, and connected components on top of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.checkpoints import cut

#: Rows of one key that a join leaves together, at least.
HOT_ROWS = 2_000
#: Keys that are dealt out at most (their table is broadcast); the threshold rises with the rows to hold it.
HOT_KEYS = 100_000


def skew_join(many: DataFrame, one: DataFrame, on: Sequence[str], rows: int, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``one`` (few rows for each key) where a key may hold any share of ``many``.

    The rows of a key with more than ``hot`` are dealt out over parts, and its rows of ``one`` are repeated once
    for each part. ``rows`` is the counted size of ``many`` or more: with at most ``hot`` rows no key can be hot,
    and since the threshold is at least ``rows`` / ``HOT_KEYS`` the broadcast table of hot keys is bounded.
    """
    on = list(on)
    if rows <= hot:
        return many.join(one, on)
    most = max(hot, rows // HOT_KEYS)
    parts = many.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    draw = F.pmod(F.xxhash64(*many.columns, F.lit(7)), F.col("_parts")).cast("int")  # by the row's own values: a task that is run again deals alike
    dealt = many.join(F.broadcast(parts), on, "left").withColumn("_part", F.coalesce(draw, F.lit(0))).drop("_parts")
    repeated = one.join(F.broadcast(parts), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"]).drop("_part")


def sized_join(many: DataFrame, one: DataFrame, on: Sequence[str], size: str, hot: int = HOT_ROWS) -> DataFrame:
    """The same where both sides carry ``size``, the rows of the key in ``many`` or more: nothing has to be counted or broadcast."""
    on = list(on)
    parts = F.ceil(F.greatest(F.col(size), F.lit(1)) / hot)
    draw = F.pmod(F.xxhash64(*many.columns, F.lit(7)), parts.cast("long")).cast("int")
    dealt = many.withColumn("_part", draw).drop(size)
    repeated = one.withColumn("_part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).drop(size)
    return dealt.join(repeated, [*on, "_part"]).drop("_part")


#: Rows of a side, counted, that is broadcast at most.
BROADCAST_ROWS = 100_000


def match(many: DataFrame, one: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """Inner join with a side that is materialised, counted, and broadcast if it has at most ``BROADCAST_ROWS`` rows, else by :func:`skew_join`."""
    held = cut(one)
    return many.join(F.broadcast(held), list(on)) if held.count() <= BROADCAST_ROWS else skew_join(many, held, on, rows)


#: Edges, counted, up to which the nodes' minima are broadcast and the work is done in one partition for each ``PART_EDGES``.
FEW_EDGES, PART_EDGES = 100_000, 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it is joined to, by large and small stars in turn.

    The root of a large component is a node of as many edges, so both stars join by :func:`skew_join` unless there are
    few edges in all.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), estimate=False)
    before, n = None, e.count()

    def packed(df: DataFrame) -> DataFrame:
        return df.coalesce(n // PART_EDGES + 1) if n <= FEW_EDGES else df

    def join(many: DataFrame, low: DataFrame) -> DataFrame:
        return many.join(F.broadcast(packed(low)), "u") if n <= FEW_EDGES else skew_join(many, low, ["u"], 2 * n)

    e = packed(e)
    while True:
        both = e.select(_both(("u", "v"), ("v", "u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(packed(join(large, low).select(_both(("v", "m"), ("u", "m"))).filter("u <> v").distinct()), estimate=False)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(_both(("u", "v"), ("v", "v"))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
        n = max(n, now[0])


def _both(*pairs: tuple[str, str]) -> Column:
    """Several (u, v) rows from the columns of one."""
    return F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs)))
