"""Exact dedup against a minimal perfect hash of historical digests.

The history is a table of shards. Each shard holds the distinct SHA-256 digests whose prefix falls into
it: a minimal perfect hash (hash and displace: every bucket of about four keys has a displacement that
puts its keys into free slots, single keys are put into the last free slots directly), and for each slot
the full 32-byte digest, the winner's locator and the number of rows seen. A lookup hashes to one slot
and compares all 32 bytes, since a minimal perfect hash gives a slot to nonmembers too. Members join
their slot's group; nonmembers are grouped among themselves by digest.

Rows of equal digest are counted before any shuffle, so a text that fills a third of the corpus is one
row by the time it reaches a shard. A shard meets at most about ``SHARD_KEYS`` digests of either side at any corpus size.

Edge cases: a null text counts as empty; of repeated rows (same id and text) exactly one is kept; a null
id loses to any other; an empty table gives no rows; other columns are ignored by :func:`groups` and
carried by :func:`dedup`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, fresh, query, rows_once, small, table, text_of

#: Distinct digests of either side in a shard, about.
SHARD_KEYS = 10_000
_PER_BUCKET = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, n long, known boolean"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest; the first picks the bucket, the second the slot."""
    w = digests.view(">u8").astype(np.uint64)
    return w[:, 1], w[:, 2]


def _slot(h: np.ndarray, seed: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (seed.astype(np.uint64) * _GOLDEN)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and the slot of each of the distinct digests (uint8, n x 32). Negative: the slot itself is -value - 1."""
    m = len(digests)
    disp = np.zeros(max(1, -(-m // _PER_BUCKET)), dtype=np.int64)
    slots = np.full(m, -1, dtype=np.int64)
    if not m:
        return disp, slots
    bucket_word, slot_word = _words(digests)
    bucket = (bucket_word % np.uint64(len(disp))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(len(disp) + 1))
    sizes = np.diff(first)
    taken = np.zeros(m, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        keys = order[first[b] : first[b + 1]]
        h, start = slot_word[keys], 1
        while True:
            seeds = np.arange(start, start + 64, dtype=np.int64)  # 64 tries at a time
            at = _slot(h[None, :], seeds[:, None], m)
            ranked = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                disp[b], slots[keys], taken[at[k]] = seeds[k], at[k], True
                break
            start += 64
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(sizes == 1):
        s = int(next(free))
        disp[b], slots[order[first[b]]] = -s - 1, s
    return disp, slots


def find_slots(disp: np.ndarray, m: int, digests: np.ndarray) -> np.ndarray:
    """The only slot that each digest can be in."""
    bucket_word, slot_word = _words(digests)
    d = disp[(bucket_word % np.uint64(len(disp))).astype(np.int64)]
    return np.where(d < 0, -d - 1, _slot(slot_word, d, m))


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, 32).copy()


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    disp, slots = build_mph(digests)
    held, keep, row, n = (np.empty_like(a) for a in (digests, pdf["keep_row"].to_numpy(), pdf["keep_row"].to_numpy(), pdf["n"].to_numpy()))
    held[slots], row[slots], n[slots] = digests, pdf["keep_row"].to_numpy(), pdf["n"].to_numpy()
    ids = pdf["keep_id"].astype("Int64")
    keep[slots] = ids.fillna(0).to_numpy(dtype=np.int64)
    null = np.empty(len(slots), dtype=np.uint8)
    null[slots] = ids.isna().to_numpy()
    return pd.DataFrame({"shard": [key[0]], "displacements": [disp.tobytes()], "digests": [held.tobytes()], "keep_ids": [keep.tobytes()], "no_id": [null.tobytes()], "keep_rows": [row.tobytes()], "counts": [n.tobytes()]})


def _lookup_shard(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: the history's slots with the batch's rows added, then the nonmembers."""
    out = []
    found = np.zeros(len(batch), dtype=bool)
    if len(index):
        r = index.iloc[0]
        held = np.frombuffer(r["digests"], dtype=np.uint8).reshape(-1, 32)
        keep = pd.Series(np.frombuffer(r["keep_ids"], dtype=np.int64).copy(), dtype="Int64")
        keep[np.frombuffer(r["no_id"], dtype=np.uint8).astype(bool)] = pd.NA
        row, n = (np.frombuffer(r[c], dtype=np.int64).copy() for c in ("keep_rows", "counts"))
        if len(batch):
            own = _matrix(batch["digest"])
            at = find_slots(np.frombuffer(r["displacements"], dtype=np.int64), len(held), own)
            found = (held[at] == own).all(axis=1)  # all 32 bytes: nonmembers land in slots too
            at, more = at[found], batch[found]
            ids = more["keep_id"].astype("Int64")
            n[at] += more["n"].to_numpy()
            rank = lambda v: v.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64)  # noqa: E731  null loses to any id
            mine, theirs, rows = rank(keep.iloc[at]), rank(ids), more["keep_row"].to_numpy()
            null = keep.iloc[at].isna().to_numpy().astype(int) - ids.isna().to_numpy().astype(int)
            wins = (theirs > mine) | ((theirs == mine) & ((null > 0) | ((null == 0) & (rows > row[at]))))
            keep.iloc[at[wins]] = ids.to_numpy()[wins]
            row[at[wins]] = rows[wins]
        out.append(pd.DataFrame({"digest": [d.tobytes() for d in held], "keep_id": keep, "keep_row": row, "n": n, "known": True}))
    if (~found).any():
        new = batch[~found]
        out.append(pd.DataFrame({"digest": list(new["digest"]), "keep_id": new["keep_id"].astype("Int64").array, "keep_row": new["keep_row"].to_numpy(), "n": new["n"].to_numpy(), "known": False}))
    return pd.concat(out, ignore_index=True)


def _winners(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each distinct digest, counted before the shuffle."""
    g = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "_row")).alias("w"), F.count("*").alias("n"))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return g.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w._row").alias("keep_row"), "n", shard.alias("shard"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The historical index, one row for each shard, from rows (doc_id, _row, digest)."""
    schema = "shard int, displacements binary, digests binary, keep_ids binary, no_id binary, keep_rows binary, counts binary"
    return _winners(rows, shards).groupBy("shard").applyInPandas(_build_shard, schema)


def look_up(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """All groups after the rows were looked up; ``known`` is false for digests that the history lacks."""
    return index.groupBy("shard").cogroup(_winners(rows, shards).groupBy("shard")).applyInPandas(_lookup_shard, GROUP_SCHEMA)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, _row) of every row."""
    return rows_once(docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text).cast("binary"), 256)).alias("digest")))


def groups(rows: DataFrame, history: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Index ``history`` (rows as from :func:`digests`), look ``rows`` up, and return the groups of both.

    A task reads one shard of the history with the rows that fall into it, so the larger side sets how many there are: a
    history that is small or empty beside the batch is no bottleneck.
    """
    shards = max(1, -(-max(history.count(), rows.count()) // shard_keys))
    return look_up(build_index(history, shards), rows, shards)


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows and the groups of one corpus: its even half by CRC-32 of the id is the history, the rest is looked up."""
    rows = digests(docs, key, text)
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    return rows, groups(rows.filter(~old), rows.filter(old))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document, dropped ones too."""
    rows, found = decide(docs, key, text)
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("_row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "known",
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each text.

    Rows that lose are taken out by id and digest, so the texts are shuffled once, or not at all while the
    losers are few. Repeated rows of a winner can't be told apart that way: only where there are any are the
    rows that are left dealt out by id and digest to keep one.
    """
    rows, found = decide(docs, key, text)
    judged = cut(rows.join(found, "digest").select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("winner"), (F.col("_row") == F.col("keep_row")).alias("kept")))
    i, h = fresh(docs, "_id", "_digest")
    losers = small(judged.filter("not winner").select(F.col("doc_id").alias(i), F.col("digest").alias(h)).distinct())
    digest = F.unhex(F.sha2(text_of(text).cast("binary"), 256))
    left = docs.join(losers, F.col(key).cast("long").eqNullSafe(F.col(i)) & (digest == F.col(h)), "left_anti")
    if judged.filter("winner and not kept").isEmpty():
        return left
    return left.withColumn(h, digest).dropDuplicates([key, h]).drop(h)


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


@query("op5_exact_dedup", SQL)
def op5(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents")).drop("known")
