"""What the operators share: inputs, lineage cuts and the registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.checkpoints import cut
from tidegauge.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
__all__ = ["ORACLES", "QUERIES", "chunks", "cut", "folds", "fresh", "query", "rows_once", "slices", "small", "table", "text_of"]


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


#: Keys that are broadcast at most; larger tables are joined by shuffle.
BROADCAST_KEYS = 300_000


def small(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """Materialise a table of keys and mark it for broadcast if it has at most ``rows`` rows (counted)."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= rows else held


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front until no column of the frame has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def folds(n: int, left_out: int, key: str = "doc_id") -> Column:
    """True where crc32 of the id as text has remainder ``left_out`` modulo ``n`` (null ids are never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)) == left_out, F.lit(False))


def rows_once(df: DataFrame) -> DataFrame:
    """Add ``_row``, a unique row number, and fix it by a checkpoint (repeated rows and null keys stay apart)."""
    return cut(df.withColumn("_row", F.monotonically_increasing_id()))


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of text (column ``text``; a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def chunks(texts: list, rows: int = 256, size: int = 1 << 19) -> Iterator[slice]:
    """The same for a list of texts: slices of it."""
    at = n = held = 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if n and (n >= rows or held + k > size):
            yield slice(at, i)
            at, n, held = i, 0, 0
        n, held = n + 1, held + k
    if n:
        yield slice(at, at + n)
