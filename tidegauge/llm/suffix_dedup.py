"""Removal of repeated byte strings by suffix arrays that are sorted in two stages.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else in the corpus. To sort all
suffixes of a corpus at once no task is large enough, so the places that can match are brought together first:

1. Every string of ``LENGTH`` bytes has an anchor, the run of ``GRAM`` bytes in it with the least hash (the first of
   equal ones). Equal strings have equal anchors, and about one place in 70 is an anchor. Anchors that occur once in the
   corpus are dropped, and with them all texts that hold no other.
2. The bytes around a repeated anchor that its strings cover are a piece. Equal pieces are counted and travel once.
3. Pieces of one anchor meet in one task, which joins those of many anchors to one text, builds its suffix array
   (:mod:`suffix_array`: direct sort of the suffixes smaller than their successors, the rest by bucket scans) and
   compares each string with its neighbour in the order: a common prefix of ``LENGTH`` bytes, or a piece that was
   counted twice, is a repeat.

An anchor with more than ``HOT`` different pieces (a line that a third of the corpus holds) is split: its pieces are cut
into parts of fewer starts, which share all but a few bytes, and the part's common bytes are the key in place of the
anchor. The last round has one start for each part, so that equal strings are one piece and no key is hot any more.

Texts with equal digests are one text; where there are two, all of it is repeated. Lists go through checkpoints in the
shared folder. Nothing is collected but counts.

Edge cases: a null text counts as empty; texts shorter than ``LENGTH`` bytes keep all; repeated rows and equal ids are
documents of their own; null ids are kept; an empty table gives no rows; other columns are ignored by :func:`report` and
carried by :func:`dedup`. What is left of a text may begin or end within a character: :func:`dedup` returns bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, fresh, query, small, table, text_of
from tidegauge.llm.suffix_array import common_prefixes, suffix_array, words
from tidegauge.plans.skew import skew_join

#: Bytes of a string that must not occur twice.
LENGTH = 200
#: Bytes of an anchor (a power of two).
GRAM = 64
#: Different pieces of one key that a task sorts together, and starts in a part of a piece in each further round.
HOT, PARTS = 2_000, (8, 1)
#: Bytes of pieces that are sorted at once, about; bytes of text that are hashed at once.
SORTED_BYTES, HASHED_BYTES = 1 << 20, 1 << 17
_PLACE = np.uint64((1 << 18) - 1)
_FACTOR = 0x9E3779B97F4A7C15


def _byte_hashes() -> np.ndarray:
    """A 64-bit number for each byte value."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(_FACTOR)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


_BYTES = _byte_hashes()


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, n, factor = _BYTES[t], 1, _FACTOR
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each place, place of the anchor of the string at each place); fewer than 2**18 bytes, at least ``length``."""
    h, width = gram_hashes(t), length - GRAM + 1
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first place is the least
    n = 1
    while 2 * n <= width:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if width > n:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    return h, (low & _PLACE).astype(np.int64)


def anchored(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of starts with one anchor: (index of the text, first starts, numbers of starts, distances from there to the anchors, hashes).

    Short texts are hashed together; of a longer one each part begins where the last one's starts end.
    """
    def runs(t: np.ndarray, firsts: np.ndarray, ends: np.ndarray):
        h, at = anchors(t, length)
        for k, (a, b) in enumerate(zip(firsts, ends, strict=True)):
            own = at[a : b - length + 1]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield k, new, np.diff(np.r_[new, len(own)]), own[new] - a - new, h[own[new]]

    group: list[int] = []
    held = 0

    def flush():
        ends = np.cumsum([len(texts[i]) for i in group])
        joined = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
        for k, *found in runs(joined, np.r_[0, ends[:-1]], ends):
            yield group[k], *found

    for i, x in enumerate(texts):
        if len(x) < length:
            continue
        if len(x) >= HASHED_BYTES:
            t = np.frombuffer(x, dtype=np.uint8)
            for shift in range(0, len(x) - length + 1, HASHED_BYTES):
                part = t[shift : shift + HASHED_BYTES + length - 1]
                for _, starts, *found in runs(part, np.array([0]), np.array([len(part)])):
                    yield i, starts + shift, *found
            continue
        if held + len(x) > HASHED_BYTES and group:
            yield from flush()
            group, held = [], 0
        group.append(i)
        held += len(x)
    if group:
        yield from flush()


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = batch.column(text).to_pylist()
    at = held = 0
    for i, x in enumerate(sizes):
        if held and held + len(x) > 1 << 20:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += len(x) + 16
    if at < batch.num_rows:
        yield batch.slice(at)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _anchor_rows(length: int, places: bool):
    """(anchor, uid, place) of every anchor in (uid, text), or (anchor, occurrence), which mixes the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                ids = batch.column(0).to_numpy().view(np.uint64)
                key, uid, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i, starts, _, _, h in anchored(batch.column(1).to_pylist(), length):
                    key.append(h)
                    at.append(starts)
                    uid.append(np.full(len(h), ids[i]))
                k, u, a = np.concatenate(key), np.concatenate(uid), np.concatenate(at)
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(k)), pa.array(_signed(u)), pa.array(a)], ["anchor", "uid", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(k)), pa.array(_signed(u ^ (a.astype(np.uint64) * np.uint64(_FACTOR))))], ["anchor", "occurrence"])

    return run


def _piece_id(b) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b)
    return (x >> 64) - (1 << 63), (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


#: Columns that name a piece, and those of a piece with its bytes.
_PIECE = "key long, p1 long, p2 long"
_BODY = f"{_PIECE}, lead int, seen long, bytes binary"


def _occurrence_rows(length: int):
    """The pieces of (digest, text, places): (digest, first start, number of starts, distance to the anchor, key, id of the piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                names, texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                found = [np.sort(p.values.to_numpy()) for p in places]
                out = [[] for _ in range(7)]
                for i, starts, n, lead, h in anchored(texts, length):
                    view, mine = memoryview(texts[i]), np.isin(starts, found[i])
                    for s, m, x, k in zip(starts[mine].tolist(), n[mine].tolist(), lead[mine].tolist(), _signed(h[mine]).tolist(), strict=True):
                        for column, value in zip(out, (names[i], s, m, x, k, *_piece_id(view[s : s + m + length - 1])), strict=True):
                            column.append(value)
                kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], ["digest", "start", "n", "lead", "key", "p1", "p2"])

    return run


def _piece_bytes(length: int):
    """(digest, text, pieces) to one row for each piece, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                texts, lists = batch.column(1).to_pylist(), batch.column(2)
                flat, at = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                start, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
                body = [texts[i][s : s + m + length - 1] for i, s, m in zip(at.tolist(), start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field(c) for c in ("key", "p1", "p2", "lead", "seen")] + [pa.array(body, type=pa.binary())], ["key", "p1", "p2", "lead", "seen", "bytes"])

    return run


def repeated_starts(pieces: list[bytes], seen: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its strings occur twice: in a piece counted twice, or beside an equal one in the suffix array."""
    t = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    first = np.r_[0, np.cumsum(sizes)]
    starts = np.maximum(sizes - length + 1, 0)
    at = np.repeat(first[:-1] - np.r_[0, np.cumsum(starts)[:-1]], starts) + np.arange(starts.sum())
    wanted = np.zeros(len(t), dtype=bool)
    wanted[at] = True
    w = words(t, length)
    order = suffix_array(t, wanted, length, w)
    same = common_prefixes(w, order, length) >= length
    twice = np.zeros(len(t), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[at] |= np.repeat(seen > 1, starts)
    return [twice[a : a + n] for a, n in zip(first[:-1].tolist(), starts.tolist(), strict=True)]


def _sort_rows(length: int):
    """Rows (key, p1, p2, lead, seen, bytes) in the order of their keys to (key, p1, p2, starts), starts a bit for each one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            marks = repeated_starts([r[5] for r in rows], np.array([r[4] for r in rows]), length)
            kept = [(*r[:3], np.packbits(m, bitorder="little").tobytes()) for r, m in zip(rows, marks, strict=True) if m.any()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], type=k) for i, k in enumerate(kinds)], ["key", "p1", "p2", "starts"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SORTED_BYTES and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
        if rows:
            yield flush(rows)

    return run


def _part_rows(length: int, most: int):
    """Pieces cut into parts of at most ``most`` starts, keyed by the bytes that all strings have that start so far before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["o_key", "o_p1", "o_p2", "shift", "key", "p1", "p2", "lead", "seen", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                out = []
                for k, p1, p2, lead, seen, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    s, starts = 0, len(body) - length + 1
                    while s < starts:
                        least = (lead - s) // most * most  # the band of distances to the anchor: least to least + most - 1
                        end = min(starts, lead - least + 1)
                        b = body[s : end + length - 1]
                        core = xxhash.xxh3_64_intdigest(body[lead - least : lead - least - most + 1 + length], seed=least) - (1 << 63)
                        out.append((k, p1, p2, s, core, *_piece_id(b), lead - s, seen, b))
                        s = end
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names)

    return run


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts' marks (key, p1, p2, list of shift and starts) back to one mark for each piece."""
    for batch in batches:
        rows = []
        for k, p1, p2, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mark = np.zeros(max(p["shift"] + 8 * len(p["starts"]) for p in parts), dtype=bool)
            for p in parts:
                bits = np.unpackbits(np.frombuffer(p["starts"], dtype=np.uint8), bitorder="little").astype(bool)
                mark[p["shift"] : p["shift"] + len(bits)] |= bits
            rows.append((k, p1, p2, np.packbits(mark, bitorder="little").tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], ["key", "p1", "p2", "starts"])


def _marks(pieces: DataFrame, counts: DataFrame, length: int, parts: tuple[int, ...]) -> DataFrame:
    """(key, p1, p2, starts) of the pieces that hold a repeated start. ``counts`` has the different pieces of each key (key, n)."""
    sort = _sort_rows(length)
    hot = cut(counts.filter(F.col("n") > HOT).select("key")) if parts else None
    many = hot.count() if parts else 0
    cold = pieces if not many else pieces.join(small(hot), "key", "left_anti")
    marks = cold.repartition("key").sortWithinPartitions("key").mapInArrow(sort, f"{_PIECE}, starts binary")
    if not many:
        return marks
    split = cut(pieces.join(small(hot), "key", "left_semi").mapInArrow(_part_rows(length, parts[0]), f"o_key long, o_p1 long, o_p2 long, shift int, {_BODY}"))
    once = cut(split.groupBy("key", "p1", "p2").agg(F.first("lead").alias("lead"), F.sum("seen").alias("seen"), F.first("bytes").alias("bytes")))
    found = cut(_marks(once, once.groupBy("key").agg(F.count("*").alias("n")), length, parts[1:]))
    back = skew_join(split.drop("lead", "seen", "bytes"), found, ["key", "p1", "p2"], split.count())
    joined = back.groupBy(F.col("o_key").alias("key"), F.col("o_p1").alias("p1"), F.col("o_p2").alias("p2")).agg(F.collect_list(F.struct("shift", "starts")).alias("parts"))
    return marks.unionByName(joined.mapInArrow(_joined_rows, f"{_PIECE}, starts binary"))


def _span_rows(length: int):
    """(digest, text, marks of pieces) to (digest, n_removed, spans, kept): spans are pairs of ends of the maximal removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                out = []
                for name, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    cover = np.zeros(len(text) + 1, dtype=np.int64)
                    for m in marks:
                        s = np.flatnonzero(np.unpackbits(np.frombuffer(m["starts"], dtype=np.uint8), bitorder="little")) + m["start"]
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    out.append((name, int(gone.sum()), edges.tolist(), np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()))
                kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], ["digest", "n_removed", "spans", "kept"])

    return run


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(digest, n_removed, spans, kept) of the different texts that hold a repeated string, but not of texts that stand twice as a whole.

    ``digest`` is the first half of the text's SHA-256, ``kept`` what is left of its bytes.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    raw = text_of(text).cast("binary")
    texts = docs.select(_digest(text).alias("digest"), raw.alias("text")).filter(F.octet_length("text") >= length).select("digest", F.xxhash64("digest").alias("uid"), "text")
    once = texts.select("uid", "text").mapInArrow(_anchor_rows(length, False), "anchor long, occurrence long").groupBy("anchor").agg(F.min("occurrence").alias("a"), F.max("occurrence").alias("b"))
    twice = cut(once.filter("a < b").select("anchor"))
    placed = texts.select("uid", "text").mapInArrow(_anchor_rows(length, True), "anchor long, uid long, place long")
    found = cut(placed.join(twice, "anchor").groupBy("uid").agg(F.collect_set("place").alias("places")))
    near = texts.join(small(found.select("uid")), "uid", "left_semi")
    near = near.groupBy("digest").agg(F.first("text").alias("text"), F.first("uid").alias("uid"))
    held = cut(near.join(found, "uid").select("digest", "text", "places"))
    pieces = cut(held.mapInArrow(_occurrence_rows(length), f"digest binary, start long, n int, lead int, {_PIECE}"))
    owners = cut(pieces.groupBy("key", "p1", "p2").agg(F.count("*").alias("seen"), F.min(F.struct("digest", "start", "n", "lead")).alias("at")))
    wanted = owners.select("at.digest", F.struct("at.start", "at.n", "at.lead", "key", "p1", "p2", "seen").alias("piece")).groupBy("digest").agg(F.collect_list("piece").alias("pieces"))
    bodies = held.select("digest", "text").join(wanted, "digest").mapInArrow(_piece_bytes(length), _BODY)
    marks = cut(_marks(bodies, owners.groupBy("key").agg(F.count("*").alias("n")), length, PARTS))
    own = skew_join(pieces.drop("n", "lead"), marks, ["key", "p1", "p2"], pieces.count()).groupBy("digest").agg(F.collect_list(F.struct("start", "starts")).alias("marks"))
    return held.select("digest", "text").join(own, "digest").mapInArrow(_span_rows(length), "digest binary, n_removed long, spans array<long>, kept binary")


def _digest(text: str):
    return F.substring(F.unhex(F.sha2(text_of(text).cast("binary"), 256)), 1, 16)


def _judged(docs: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Every row (key, digest, n_bytes, sha, whole), whole where an equal text stands twice and has ``length`` bytes, and the repeats."""
    raw = text_of(text).cast("binary")
    rows = cut(docs.select(F.col(key).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha")))
    rows = rows.withColumn("digest", F.substring(F.unhex("sha"), 1, 16))
    copies = small(rows.filter(F.col("n_bytes") >= length).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest", F.lit(True).alias("whole")))
    return rows.join(copies, "digest", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), repeats(docs, text, length)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans as ends in bytes (from, to, from, to, ...)."""
    rows, found = _judged(docs, key, text, length)
    found = cut(found.select("digest", "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256")))
    partly = rows.filter("not whole")
    part = skew_join(partly, found, ["digest"], partly.count()).select("doc_id", "n_bytes", "n_removed", "kept_sha256", "spans")
    rest = partly.join(small(found.select("digest")), "digest", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.array().cast("array<long>").alias("spans"))
    whole = rows.filter("whole").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.array(F.lit(0).cast("long"), "n_bytes").alias("spans"))
    every = part.unionByName(rest).unionByName(whole)
    return every.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256", "spans")


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents, all columns, with ``kept``: the bytes of the text that are left (also for whole copies, of which none keeps any)."""
    digest, kept, n, whole = fresh(docs, "_digest", "kept", "_n", "_whole")
    found = repeats(docs, text, length).select(F.col("digest").alias(digest), F.col("kept").alias(kept))
    raw = text_of(text).cast("binary")
    keyed = docs.withColumn(digest, _digest(text))
    copies = small(keyed.filter(F.octet_length(raw) >= length).groupBy(digest).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(digest, F.lit(True).alias(whole)))
    left = F.when(F.col(whole), F.lit(b"")).otherwise(F.coalesce(F.col(kept), raw))
    return keyed.join(found, digest, "left").join(copies, digest, "left").withColumn(kept, left).drop(digest, whole)


#: Every string of 200 bytes by its digest, in hexadecimal digits; texts are first cut into parts, as a place deep in a text is slow to reach.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, b, substr(h, 2 * b + 1, 1398) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 500)) AS b FROM d WHERE len(h) >= 400) y),
g AS (SELECT r, b + i AS i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, b, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM x) y),
s AS (SELECT r, i FROM g SEMI JOIN (SELECT m FROM g GROUP BY m HAVING count(*) > 1) t USING (m)),
n AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM s),
u AS (SELECT r, min(i) AS f, max(i) + 200 AS t FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM n) y GROUP BY r, run),
p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY r ORDER BY f), 0) AS q FROM u),
k AS (SELECT r, sum(t - f)::BIGINT AS gone, count(*) AS spans, max(t) AS e, string_agg(substr(h, 2 * q + 1, 2 * (f - q)), '' ORDER BY f) AS head FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN h ELSE head || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


@query("op11_suffix_dedup", SQL)
def op11(spark, sf_dir):
    return report(table(spark, sf_dir, "documents")).drop("spans")
