"""Values with the listed prefixes that they start with, by one merge over sorted ranges.

Values and prefixes are put into ranges by the same bounds, each side in one shuffle, and sorted by their bytes. Where a prefix stands
before a value that starts with it, all that stands between them starts with it too; so one pass with a stack of the
prefixes that are still open gives every value its prefixes, whatever their lengths, and no value is copied for a length.
A range begins with the open prefixes of its first key: these are prefixes of that key, and looked up for the first keys only.

A batch gives each of its values once before the shuffle, so that a value which a third of the rows hold is few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.checkpoints import cut


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pc.unique(b.column(0))], ["k"])


def _merge(given, every: bool):
    """Sorted rows (k, prefix, _range) of one or more ranges to (value, found): each different value with its longest prefix, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, stack = None, (None, False), []
        started = False
        for batch in batches:
            values, found = [], []
            for k, is_prefix, part in zip(*(batch.column(c).to_pylist() for c in ("k", "prefix", "_range")), strict=True):
                if part != at:
                    at, stack, started = part, list(given.value.get(part, ())), False
                if started and (k, is_prefix) == last:
                    continue
                started, last = True, (k, is_prefix)
                while stack and (k is None or not k.startswith(stack[-1])):
                    stack.pop()
                if is_prefix:
                    if not stack or stack[-1] != k:
                        stack.append(k)
                elif every:
                    values += [k] * len(stack)
                    found += stack
                else:
                    values.append(k)
                    found.append(stack[-1] if stack else None)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(found, pa.binary())], ["value", "found"])

    return run


def prefixes_of(values: DataFrame, col: str, prefixes: DataFrame, prefix: str, every: bool = False, ranges: int | None = None) -> DataFrame:
    """(col, prefix) for each different value: its longest listed prefix or null; with ``every`` a row for each of its prefixes, and none for others.

    Null values have no prefix, null prefixes are none, and the empty prefix is one of every text.
    """
    spark = values.sparkSession
    left = values.select(F.col(col).cast("binary").alias("k")).mapInArrow(_once, "k binary").withColumn("prefix", F.lit(False))
    right = prefixes.select(F.col(prefix).cast("binary").alias("k")).filter("k IS NOT NULL").mapInArrow(_once, "k binary").withColumn("prefix", F.lit(True))
    both = left.unionByName(right)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(both.repartitionByRange(n, "k").sortWithinPartitions("k", F.desc("prefix")).withColumn("_range", F.spark_partition_id()))
    # the first key of each range, and the listed prefixes of these keys
    firsts = held.groupBy("_range").agg(F.min("k").alias("first")).filter("first IS NOT NULL")
    cuts = firsts.select("_range", F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("first")), lambda i: F.substring("first", F.lit(1), i))).alias("k"))
    open_ = held.filter("prefix").select("k").join(F.broadcast(cuts), "k").select("_range", "k").distinct()
    at_start: dict[int, list[bytes]] = {}
    for r in open_.collect():  # at most as many as the first keys have bytes
        at_start.setdefault(r["_range"], []).append(bytes(r["k"]))
    given = spark.sparkContext.broadcast({p: sorted(x, key=len) for p, x in at_start.items()})
    found = held.mapInArrow(_merge(given, every), "value binary, found binary")
    return found.select(F.col("value").cast("string").alias(col), F.col("found").cast("string").alias(prefix))
