"""Frequent itemsets on vertical bitmaps (Eclat), range by range.

Baskets are dealt into ranges of about ``RANGE``. A task turns a range into one bitmap for each item and searches depth first:
sets of two are intersections, and from there on a set is held as its difference to the set without its last item, which is
short where items go together. Bitmaps are cut to the words in which their first item occurs at all.

A set that reaches the support in the corpus reaches its share of it in one range at least. So the first pass finds what is
frequent in any range, and the second counts just these sets in every range; both passes read (basket, item) rows dealt by range,
and no basket is joined with itself. The candidates are sent out ``SETS`` at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.checkpoints import cut

#: Baskets in a range, about; candidates that are counted at once; words of bitmaps that are intersected at once.
RANGE, SETS, WORDS = 1 << 15, 200_000, 1 << 21


class Bitmaps:
    """Bitmaps of the items of a range, items in order."""

    def __init__(self, table: pa.Table):
        baskets, items = table.column("basket").combine_chunks().dictionary_encode(), table.column("item").combine_chunks().dictionary_encode()
        order = np.argsort(np.array(items.dictionary.to_pylist(), dtype=object), kind="stable")
        self.items = items.dictionary.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.baskets = len(baskets.dictionary)
        bits = np.zeros((len(order), -(-max(1, self.baskets) // 64) * 64), dtype=bool)
        bits[place[items.indices.to_numpy()], baskets.indices.to_numpy()] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.sizes = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    def frequent(self, least: int, most: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(item numbers, baskets) of all sets of at most ``most`` items in at least ``least`` baskets."""
        alone = np.flatnonzero(self.sizes >= least)
        for k, x in enumerate(alone):
            yield (int(x),), int(self.sizes[x])
            later = alone[k + 1 :]
            if most < 2 or not len(later):
                continue
            used = np.flatnonzero(self.bits[x])
            mine = self.bits[x, used]
            others = self.bits[np.ix_(later, used)]
            n = np.bitwise_count(others & mine).sum(axis=1, dtype=np.int64)
            keep = n >= least
            # the baskets of x that lack y
            yield from _deeper((int(x),), later[keep], n[keep], mine & ~others[keep], least, most)

    def count(self, sets: np.ndarray) -> np.ndarray:
        """Baskets that hold all items of each set (rows of item numbers)."""
        out = np.empty(len(sets), dtype=np.int64)
        step = max(1, WORDS // self.bits.shape[1])
        for i in range(0, len(sets), step):
            part = sets[i : i + step]
            both = self.bits[part[:, 0]].copy()
            for c in range(1, part.shape[1]):
                both &= self.bits[part[:, c]]
            out[i : i + step] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out


def _deeper(prefix: tuple[int, ...], items: np.ndarray, n: np.ndarray, lacking: np.ndarray, least: int, most: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The sets that begin with a prefix and one of the items, given their baskets and those of the prefix that they lack."""
    for k, y in enumerate(items):
        own = (*prefix, int(y))
        yield own, int(n[k])
        if len(own) < most and k + 1 < len(items):
            less = lacking[k + 1 :] & ~lacking[k]
            m = n[k] - np.bitwise_count(less).sum(axis=1, dtype=np.int64)
            keep = m >= least
            if keep.any():
                yield from _deeper(own, items[k + 1 :][keep], m[keep], less[keep], least, most)


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.withColumn("range", F.pmod(F.xxhash64("basket"), F.lit(ranges)))


def _rows(sets: list, counts: list, items: pa.Array, kind: pa.DataType) -> pa.Table:
    flat = items.take(pa.array([i for s in sets for i in s], type=pa.int64()))
    ends = np.cumsum([0, *(len(s) for s in sets)])
    return pa.table({"items": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.cast(kind)), "n": pa.array(counts, pa.int64())})


def _counting(given):
    """Counts of the broadcast sets that a range holds."""

    def run(table: pa.Table) -> pa.Table:
        maps = Bitmaps(table)
        place = {x: k for k, x in enumerate(maps.items.to_pylist())}
        by: dict[int, list[int]] = {}
        numbers = [[place.get(x, -1) for x in s] for s in given.value]
        for k, s in enumerate(numbers):
            if min(s) >= 0:
                by.setdefault(len(s), []).append(k)
        found, n = [], []
        for some in by.values():
            counts = maps.count(np.array([numbers[k] for k in some]))
            found += [some[k] for k in np.flatnonzero(counts)]
            n += counts[counts > 0].tolist()
        return _rows([numbers[k] for k in found], n, maps.items, table.schema.field("item").type)

    return run


def supports(rows: DataFrame, sets: DataFrame, ranges: int) -> DataFrame:
    """(items, n) for each different set (sorted items) of at least one item; rows are distinct (basket, item)."""
    kind = rows.schema["item"].dataType.simpleString()
    held = cut(sets.select("items").filter(F.size("items") > 0).distinct().withColumn("_id", F.monotonically_increasing_id()))
    parts = max(1, math.ceil(held.count() / (SETS * 4 // 5)))
    out = None
    for i in range(parts):
        part = held.filter(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i)
        given = rows.sparkSession.sparkContext.broadcast([list(r["items"]) for r in part.select("items").collect()])

        here = _dealt(rows, ranges).groupBy("range").applyInArrow(_counting(given), f"items array<{kind}>, n long").groupBy("items").agg(F.sum("n").alias("n"))
        here = part.select("items").join(here, "items", "left").select("items", F.coalesce("n", F.lit(0)).alias("n"))
        out = here if out is None else out.unionByName(here)
    return out


def prepared(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    return baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").distinct()


def ranges_of(baskets: int) -> int:
    return max(1, math.ceil(baskets / RANGE))


def eclat(baskets: DataFrame, basket: str, item: str, least: int, most: int) -> DataFrame:
    """Itemsets (sorted items, n) of at most ``most`` items in at least ``least`` baskets; null items and baskets don't count."""
    rows = cut(prepared(baskets, basket, item))
    single = cut(rows.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    alone = single.select(F.array("item").alias("items"), "n")
    if most < 2:
        return alone
    rows = cut(rows.join(single.select("item"), "item", "left_semi").select("basket", "item"))
    m = rows.agg(F.count_distinct("basket")).first()[0]
    kind = rows.schema["item"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        maps = Bitmaps(table)
        share = max(1, math.ceil(least * maps.baskets / m - 1e-9))
        sets = [s for s, _ in maps.frequent(share, most) if len(s) > 1]
        return _rows(sets, [0] * len(sets), maps.items, table.schema.field("item").type)

    ranges = ranges_of(m)
    some = _dealt(rows, ranges).groupBy("range").applyInArrow(run, f"items array<{kind}>, n long")
    return alone.unionByName(supports(rows, some, ranges).filter(F.col("n") >= least))
