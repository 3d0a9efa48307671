"""Near-duplicate detection by ProbMinHash, banding and verification.

Documents are sets of shingles of ``SHINGLE`` words. Every shingle is a Poisson process whose rate is its
weight: its arrivals come after exponential gaps and each falls into a random register; a register keeps its
earliest arrival and the shingle it came from. A shingle stops once its next arrival is later than the latest
register (Ertl, 2020), so most shingles stop after one or two. Two documents agree in a register with the
probability Jaccard similarity of their weighted sets, and it is that similarity that is verified exactly
afterwards. By default all weights are 1, which makes it the plain Jaccard similarity of the sets: how often a
text repeats a line neither makes nor loses a link. With ``weighted`` a shingle weighs 1 + ln(count).

Documents with equal (weighted) sets form a class and take part once. A register is kept in 16 bits; ``BANDS``
bands of ``ROWS`` registers are the keys of the buckets as they stand, so buckets and registers never disagree.
At similarity 0.8 two classes share no band with probability 5e-8. In each bucket two leaders, the member that
shares the largest buckets and one drawn anew, are compared with the other members: first by the registers,
then exactly, from the whole texts. The links' connected components are the groups. What stars can miss, two
members of a bucket in different components, is then compared (:func:`_leftover`): whole stars first, by their
centers; in the bucket itself where few are left over, else among the texts that share one of their rarest shingles,
which no two texts of the similarity can avoid. Only links come out, so no group is ever gathered whole, no bucket is
capped, and a group of n near copies costs about n links. Joins on leaders, buckets and roots deal hot keys out.

Edge cases: null, empty and wordless texts have no shingles and stay alone; a text of fewer words than a
shingle is one shingle; equal texts, repeated rows among them, are one class; ties go to the smaller id; an
empty table gives no rows; other columns are ignored by :func:`report` and carried by :func:`dedup`. Repeated
rows of the winner (same id and text) are all ``kept`` in the report; :func:`dedup` returns one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, fresh, query, slices, small, table
from tidegauge.plans.checkpoints import release
from tidegauge.plans.skew import components, match, sized_join, skew_join

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: A pair is read again when its registers agree in the similarity less this share: over five standard deviations.
MARGIN = 0.2
BLOCK = 256
#: Counters of the sketch by which shingles are ordered; any order finds every pair, so its size is no matter of results.
SKETCH = 1 << 20
#: Bytes of text that are hashed together, which bounds the arrays of a worker.
_PIECE = 1 << 18
_U = np.uint64
_GOLD, _P = _U(0x9E3779B97F4A7C15), 0x100000001B3 * 2 + 1
_COEFFICIENTS = [_U(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _PIECE)
        _POWERS[:] = [np.concatenate(([_U(1)], np.cumprod(np.full(size - 1, _U(b))))) for b in (_P % 2**64, pow(_P, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a buffer that ends in a break."""
    x = np.frombuffer(buffer, dtype=np.uint8)
    word = np.concatenate(([False], _WORD_BYTE[x]))
    edge = word[1:] != word[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    power, inverse = _powers(len(x))
    total = np.concatenate(([_U(0)], np.cumsum((x.astype(np.uint64) + _U(1)) * power[: len(x)])))
    return _mix((total[ends] - total[starts]) * inverse[starts]), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``_PIECE`` bytes, cut at breaks between words."""
    at = 0
    while len(raw) - at > _PIECE:
        x = np.frombuffer(raw, dtype=np.uint8, count=_PIECE, offset=at)
        breaks = np.flatnonzero(~_WORD_BYTE[x])
        if not len(breaks):
            break
        yield raw[at : at + int(breaks[-1]) + 1]
        at += int(breaks[-1]) + 1
    yield raw[at:] + b" "


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, count) of the distinct shingles of each text, sorted. At most 65,536 texts."""
    words, of, buffer, held, size = [], [], [], [], 0

    def flush() -> None:
        if buffer:
            w, starts = _word_hashes(b"".join(buffer))
            offsets = np.cumsum([0, *map(len, buffer)])
            words.append(w)
            of.append(np.array(held, dtype=np.int64)[np.searchsorted(offsets, starts, side="right") - 1])
            buffer.clear()
            held.clear()

    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            for piece in _pieces((t or "").lower().encode("utf-8", "replace")):
                if size + len(piece) > 2 * _PIECE:
                    flush()
                    size = 0
                buffer.append(piece)
                held.append(i)
                size += len(piece)
        flush()
        w = np.concatenate([*words, np.zeros(SHINGLE, dtype=np.uint64)])
        d = np.concatenate([*of, np.full(SHINGLE, -1, dtype=np.int64)])
        n = len(w) - SHINGLE
        first = np.concatenate(([True], d[1:n] != d[: n - 1])) if n else np.zeros(0, dtype=bool)
        total, whole = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for k, c in enumerate(_COEFFICIENTS):
            whole = d[k : k + n] == d[:n]
            total += np.where(whole, w[k : k + n] * c, _U(0))
        keep = whole | first  # a text of fewer words has one shingle, from its first word
        key = (d[:n][keep].astype(np.uint64) << _U(48)) | (_mix(total[keep]) >> _U(16))
    key.sort()
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(fresh, len(key)))
    key = key[fresh]
    return (key >> _U(48)).astype(np.int64), key & _U(0xFFFFFFFFFFFF), counts


def registers(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle in each of m registers of n documents (n x m; documents without shingles stay 0). m is a power of 2."""
    time, held = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    now, step = np.zeros(len(doc)), 0
    with np.errstate(over="ignore"):
        seed = _mix(shingle + _GOLD)
        while len(doc):
            many = max(1, min(64, 32768 // len(doc)))  # a few shingles draw several arrivals at once
            draws = _mix(seed[:, None] + (np.arange(step + 1, step + many + 1, dtype=np.uint64) * _GOLD)[None, :])
            gaps = -np.log(((draws >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[:, None]
            arrivals = now[:, None] + np.cumsum(gaps, axis=1)
            at = (doc[:, None] * m + (draws & _U(m - 1)).astype(np.int64)).ravel()
            flat = arrivals.ravel()
            np.minimum.at(time, at, flat)
            won = time[at] == flat
            held[at[won]] = np.repeat(shingle, many)[won]
            latest = time.reshape(n, m).max(axis=1)
            now = arrivals[:, -1]
            alive = now < latest[doc]
            doc, shingle, weight, seed, now = doc[alive], shingle[alive], weight[alive], seed[alive], now[alive]
            step += many
    return held.reshape(n, m)


def _weights(counts: np.ndarray, weighted: bool) -> np.ndarray:
    return 1 + np.log(counts) if weighted else np.ones(len(counts))


def fingerprint(texts: list[str | None], weighted: bool = False) -> tuple[list[bytes | None], np.ndarray]:
    """For each text: the digest of its (weighted) set, None without shingles, and 16 bits of each register, a row of BANDS 64-bit integers."""
    doc, shingle, counts = shingles(texts)
    held = registers(doc, shingle, _weights(counts, weighted), len(texts))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets: list[bytes | None] = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = shingle[a:b].tobytes() + (counts[a:b].tobytes() if weighted else b"")
        sets.append(hashlib.blake2b(own, digest_size=16).digest() if b > a else None)
    return sets, (held & _U(0xFFFF)).astype(np.uint16).view(np.int64)


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The registers (rows x REGISTERS) of a column of signatures, all of BANDS integers."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)).view(np.uint16).reshape(-1, REGISTERS)


def _likeness(x: np.ndarray, y: np.ndarray, m: np.ndarray | None = None, n: np.ndarray | None = None) -> float:
    """Jaccard similarity of two sorted sets of shingles, or the probability Jaccard similarity with weights m and n."""
    if m is None:
        both = np.concatenate((x, y))
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common / max(1, len(both) - common)
    each = np.union1d(x, y)
    u, v = np.zeros(len(each)), np.zeros(len(each))
    u[np.searchsorted(each, x)], v[np.searchsorted(each, y)] = m, n
    # sum over shared i of 1 / sum over j of max(u_j / u_i, v_j / v_i): which one is larger depends on v / u alone
    with np.errstate(divide="ignore"):
        order = np.argsort(v / u)
    u, v = u[order], v[order]
    before, after = np.cumsum(u) - u, np.cumsum(v[::-1])[::-1]
    shared = (u > 0) & (v > 0)
    return float((1 / (before[shared] / u[shared] + after[shared] / v[shared])).sum())


def _sets(texts: list[str | None], weighted: bool) -> list[tuple]:
    """The arguments of :func:`_likeness` that each text brings."""
    doc, shingle, counts = shingles(texts)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    weight = _weights(counts, weighted)
    return [(shingle[a:b], weight[a:b] if weighted else None) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def jaccard(left: list[str | None], right: list[str | None], weighted: bool = False) -> np.ndarray:
    """Similarity of the shingle sets of each two texts."""
    texts = list(dict.fromkeys([*left, *right]))
    own = dict(zip(texts, _sets(texts, weighted), strict=True))
    return np.array([_likeness(own[a][0], own[b][0], own[a][1], own[b][1]) for a, b in zip(left, right, strict=True)])


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """(doc_id, mark, digest, sig) of every document: the MD5 of its text, the digest of its set, its registers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, 2):
                sets, sigs = fingerprint(b.column(2).to_pylist(), weighted)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary()), sig], ["doc_id", "mark", "digest", "sig"])

    t = F.col(text).cast("string")
    three = docs.select(F.col(key).cast("long").alias("doc_id"), _mark(t).alias("mark"), t.alias("text"))
    return three.mapInArrow(batches, "doc_id long, mark binary, digest binary, sig array<bigint>")


def _mark(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _agree(pairs: DataFrame, reps: DataFrame, floor: float, n: int) -> DataFrame:
    """The pairs (leader, set) whose registers agree in at least the floor; ``n`` bounds the pairs."""
    sig = reps.select("set", "sig")
    both = skew_join(pairs.join(sig.withColumnRenamed("sig", "own"), "set"), sig.toDF("leader", "lead"), ["leader"], n)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                near = (_registers(b.column(2)) == _registers(b.column(3))).mean(axis=1) >= floor
                yield b.filter(pa.array(near)).select(["leader", "set"])

    return both.select("leader", "set", "own", "lead").mapInArrow(batches, "leader long, set long")


def _texts(sets: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(set, text) of the classes in ``sets``, each from one of its documents."""
    keys = small(match(reps.select("set", "mark"), sets.distinct(), ["set"], reps.count()))
    t = F.col(text).cast("string")
    return docs.select(_mark(t).alias("mark"), t.alias("text")).join(keys, "mark").groupBy("set").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float, text: str = "text", weighted: bool = False) -> DataFrame:
    """The pairs (leader, set) whose shingle sets have the similarity, from the whole texts of their classes."""
    texts = _texts(pairs.select(F.explode(F.array("leader", "set")).alias("set")), reps, docs, text)
    both = skew_join(pairs.join(texts.withColumnRenamed("text", "own"), "set"), texts.toDF("leader", "lead"), ["leader"], pairs.count())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, 2, rows=128):
                near = jaccard(b.column(2).to_pylist(), b.column(3).to_pylist(), weighted) >= similarity - 1e-12
                yield b.filter(pa.array(near)).select(["leader", "set"])

    return cut(both.select("leader", "set", "own", "lead").mapInArrow(batches, "leader long, set long"))


_GROUP = ["band", "bucket", "i", "j"]


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group from batches that are sorted by ``_GROUP``; a group may span batches."""
    held: pa.Table | None = None
    for b in it:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = list(zip(*(t.column(c).to_pylist() for c in _GROUP), strict=True))
        first = 0
        for k in range(1, len(keys)):
            if keys[k] != keys[k - 1]:
                yield t.slice(first, k - first)
                first = k
        held = t.slice(first) if keys else None
    if held is not None:
        yield held


def _plausible(t: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of block j with the members of block i that it may be linked to, in other components.

    A wide member stands for others that are within the distance of a link from it, so by the triangle inequality
    (which holds where registers agree with the probability of the similarity) its pairs may be that much farther
    apart. Two members that aren't wide meet in the first band only that they share, where the group is a bucket.
    """
    i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "band"))
    own, wide = t.column("own").to_numpy(), t.column("wide").to_numpy(zero_copy_only=False).astype(int)
    sig, root = _registers(t.column("sig")), t.column("root").to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for y in right:
        x = left[left < y] if i == j else left
        same = sig[x] == sig[y]
        reach = wide[x] + wide[y]
        near = (same.mean(axis=1) >= similarity - (1 - similarity) * reach - MARGIN) & (root[x] != root[y])
        if band >= 0 and near.any():
            near &= (reach > 0) | (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
        if near.any():
            yield int(y), x[near]


_COLUMNS = [*_GROUP, "set", "root", "own", "wide", "sig"]


def _together(df: DataFrame) -> DataFrame:
    return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "set")


def _narrow(groups: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Members of a group (band, bucket; set, root, wide) that may be linked to one in another component, with their blocks.

    The members of a group's largest component needn't meet each other. The others are cut into blocks of
    ``BLOCK`` and meet every block of the group. What comes out are members, never pairs.
    """
    per = groups.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    sizes = per.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).filter("n > top.n")
    sizes = sizes.select("band", "bucket", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("top.n") / (4 * BLOCK)).cast("int").alias("main"))
    draw = lambda n: F.pmod(F.xxhash64("set", F.lit(5)), n).cast("int")
    placed = match(groups, sizes, ["band", "bucket"], groups.count()).withColumn("own", F.when(F.col("root") == F.col("top"), -1 - draw(F.col("main"))).otherwise(draw(F.col("rest"))))
    # blocks of the largest component are negative and meet each block of the rest; blocks of the rest meet each other
    met = F.sequence(F.lit(0), F.col("rest") - 1)
    mine = F.sequence(-F.col("main"), F.col("rest") - 1)
    pairs = F.when(F.col("own") < 0, F.transform(met, lambda k: F.struct(F.col("own").alias("i"), k.alias("j")))).otherwise(F.transform(mine, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    dealt = placed.select("band", "bucket", "set", "root", "own", "wide", F.inline(pairs)).join(reps.select("set", "sig"), "set")

    def narrow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it):
            keep = np.zeros(t.num_rows, dtype=bool)
            for y, xs in _plausible(t, similarity):
                keep[xs] = keep[y] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    schema = "band int, bucket long, i int, j int, set long, root long, own int, wide boolean, sig array<bigint>"
    return cut(_together(dealt.select(*_COLUMNS)).mapInArrow(narrow, schema))


def _meet(groups: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float, text: str, weighted: bool) -> DataFrame:
    """Links (a, b) between members of a group (band, bucket; set, root) that are in different components: registers first, then whole texts."""
    release(docs.sparkSession)
    kept = _narrow(groups.withColumn("wide", F.lit(False)), reps, similarity)
    release(docs.sparkSession)
    texts = _texts(kept.select("set"), reps, docs, text)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it):
            own, sets = _sets(t.column("text").to_pylist(), weighted), t.column("set").to_pylist()
            found = [(min(sets[x], sets[y]), max(sets[x], sets[y])) for y, xs in _plausible(t, similarity) for x in xs if _likeness(own[x][0], own[y][0], own[x][1], own[y][1]) >= similarity - 1e-12]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return cut(_together(kept.join(texts, "set").select(*_COLUMNS, "text")).mapInArrow(compare, "a long, b long").distinct())


def _rarest(sets: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float, text: str, weighted: bool) -> DataFrame:
    """(set, bucket): each set's rarest shingles, as many as no set of the similarity can miss all (all of them where shingles have weights).

    Shingles are ordered by a sketch of ``SKETCH`` counters over all these sets, then by value.
    """
    texts = _texts(sets, reps, docs, text).select("set", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for whole in it:
            for b in slices(whole, 1):
                total += np.bincount((shingles(b.column(1).to_pylist())[1] % _U(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counted = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH, dtype=np.int64)
    sketch[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, 1):
                doc, shingle, _ = shingles(b.column(1).to_pylist())
                rows, keys = [], []
                for k, own in enumerate(np.split(shingle, np.searchsorted(doc, np.arange(1, b.num_rows)))):
                    most = len(own) if weighted else len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                    first = own[np.lexsort((own, sent.value[(own % _U(SKETCH)).astype(np.int64)]))[:most]]
                    rows += [k] * len(first)
                    keys += first.tolist()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64())], ["set", "bucket"])

    return texts.mapInArrow(pick, "set long, bucket long")


def _homes(star: DataFrame, roots: DataFrame) -> DataFrame:
    """(set, root, center, wide) of every set with links: a leader that it is linked to (else itself), and whether the center has others."""
    led = star.groupBy("set").agg(F.min("leader").alias("center"))
    own = cut(roots.withColumnRenamed("node", "set").join(small(led), "set", "left").withColumn("center", F.coalesce("center", "set")))
    wide = small(own.filter("center <> set").select("center").distinct().withColumn("wide", F.lit(True)))
    return own.join(wide, "center", "left").select("set", "root", "center", F.coalesce("wide", F.lit(False)).alias("wide"))


def _leftover(shared: DataFrame, reps: DataFrame, homes: DataFrame, docs: DataFrame, similarity: float, text: str, weighted: bool = False, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that the stars missed: members of one bucket in different components.

    A star is first compared as one, by its center: only where that is near enough for some of its members to be linked
    do the members themselves come. Buckets with more than ``block`` stars outside their largest component hold many texts
    that share a passage, say: those meet where they share one of their rarest shingles, and not in the bucket, so the
    passage itself brings nobody together.
    """
    homes = small(homes)

    def at_home(df: DataFrame) -> DataFrame:
        own = df.join(homes, "set", "left")
        return own.withColumn("root", F.coalesce("root", "set")).withColumn("center", F.coalesce("center", "set")).withColumn("wide", F.coalesce("wide", F.lit(False)))

    def stars(df: DataFrame) -> DataFrame:
        return df.select("band", "bucket", F.col("center").alias("set"), "root", "wide").distinct()

    def members(df: DataFrame, kept: DataFrame, n: int) -> DataFrame:
        return match(df.select("band", "bucket", "center", "set", "root"), kept.select("band", "bucket", F.col("set").alias("center")).distinct(), ["band", "bucket", "center"], n).drop("center")

    of = at_home(shared)
    mixed = of.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("band", "bucket", "n")
    inside = cut(sized_join(of, mixed, ["band", "bucket"], "n"))
    n = inside.count()
    cells = cut(stars(inside))
    release(docs.sparkSession)
    per = cells.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    crowded = cut(per.groupBy("band", "bucket").agg((F.sum("n") - F.max("n")).alias("others")).filter(F.col("others") > block).select("band", "bucket"))
    few = crowded.count()
    if not few:
        return _meet(cut(members(inside, _narrow(cells, reps, similarity), n)), reps, docs, similarity, text, weighted)
    crowded = small(crowded)
    loose = inside.join(crowded, ["band", "bucket"], "left_semi").select("set").distinct()
    rare = cut(at_home(_rarest(loose, reps, docs, similarity, text, weighted).select(F.lit(-1).alias("band"), "bucket", "set")))
    cells = cells.join(crowded, ["band", "bucket"], "left_anti").unionByName(stars(rare))
    kept = _narrow(cut(cells), reps, similarity)
    both = inside.select("band", "bucket", "center", "set", "root").unionByName(rare.select("band", "bucket", "center", "set", "root"))
    return _meet(cut(members(both, kept, n + rare.count())), reps, docs, similarity, text, weighted)


def representatives(found: DataFrame) -> DataFrame:
    """(set, digest, mark, sig, first, n) of each class: a number that the checkpoint fixes, a text's mark, the registers, the smallest (doc_id, mark), and the documents."""
    each = found.filter("digest is not null").groupBy("digest").agg(F.first("sig").alias("sig"), F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n"))
    return cut(each.select(F.monotonically_increasing_id().alias("set"), "digest", F.col("first.mark").alias("mark"), "sig", "first", "n"))


def buckets(reps: DataFrame) -> DataFrame:
    """(band, bucket, set, n) of the buckets with several members; a bucket is what the registers of a band hold."""
    members = reps.select("set", F.posexplode("sig").alias("band", "bucket"))
    full = members.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(match(members, full, ["band", "bucket"], BANDS * reps.count()))


def links(docs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, text: str = "text", weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes, enough to join all that verified links join, and the components (node, root); ``reps`` is from :func:`representatives`."""
    shared = buckets(reps)
    # who shares the largest buckets is the likely origin of a group; the other leader is drawn
    central = shared.groupBy("set").agg(F.sum("n").alias("c"))
    drawn = F.xxhash64("set", "bucket", "band")
    leaders = shared.join(central, "set").groupBy("band", "bucket", "n").agg(F.max(F.struct("c", drawn, "set")).alias("l"), F.min(F.struct(drawn, "set")).alias("r"))
    leaders = leaders.select("band", "bucket", "n", F.explode(F.array_distinct(F.array("l.set", "r.set"))).alias("leader"))
    pairs = sized_join(shared, leaders, ["band", "bucket"], "n").filter("set <> leader").select("leader", "set").distinct()
    near = cut(_agree(pairs, reps, similarity - MARGIN, 2 * shared.count()))
    release(docs.sparkSession)
    star = verify(near, reps, docs, similarity, text, weighted)
    release(docs.sparkSession)
    sure = cut(_skeleton(star))
    roots = cut(components(sure))
    release(docs.sparkSession)
    more = _leftover(shared, reps, _homes(star, roots), docs, similarity, text, weighted)
    if not more.isEmpty():
        sure = sure.union(more)
        roots = cut(components(sure))
    return sure, roots


def _skeleton(star: DataFrame) -> DataFrame:
    """Edges (a, b) that join what the links (leader, set) join: every set with its smallest leader, and each of its other leaders with that one.

    A set has at most two leaders a band, so near copies of one text give an edge each, and the leaders a few more.
    """
    own = star.groupBy("set").agg(F.array_sort(F.collect_set("leader")).alias("leaders")).select("set", F.col("leaders")[0].alias("center"), "leaders")
    others = own.select(F.explode("leaders").alias("a"), F.col("center").alias("b")).filter("a <> b").distinct()
    return own.select(F.col("set").alias("a"), F.col("center").alias("b")).unionByName(others)


def report(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest id that it is linked to, directly or not), class_size, kept, and the text's mark."""
    found = cut(classes(docs, key, text, weighted))
    reps = representatives(found)
    _, roots = links(docs, reps, similarity, text, weighted)
    release(docs.sparkSession)
    linked = cut(match(reps.select("set", "first", "n"), roots.withColumnRenamed("node", "set"), ["set"], reps.count()))
    groups = linked.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    joined = match(linked.select("root", "set"), groups, ["root"], linked.count()).drop("root")
    named = reps.select("set", "digest", "first", "n").join(small(joined), "set", "left")
    named = named.select("digest", F.coalesce("best", "first").alias("best"), F.coalesce("class_size", "n").alias("class_size"))
    rows = found.select("doc_id", "mark", "digest")
    out = skew_join(rows.filter("digest is not null"), named, ["digest"], found.count()).unionByName(rows.filter("digest is null"), allowMissingColumns=True)
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark")))).alias("kept"),
        "mark",
    )


def dedup(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """The documents, all columns, with one of each group: the smallest id, once. Documents without words all stay."""
    i, m, r = fresh(docs, "_id", "_mark", "_whole")
    judged = cut(report(docs, similarity, key, text, weighted))
    gone = small(judged.filter("not kept").select(F.col("doc_id").alias(i), F.col("mark").alias(m)).distinct())
    # repeated rows of a winner: set apart from the documents without words, each of which stays, by their class size
    twice = judged.filter("kept and class_size > 1").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1")
    twice = small(twice.select(F.col("doc_id").alias(i), F.col("mark").alias(m)))
    t = F.col(text).cast("string")
    same = F.col(key).cast("long").eqNullSafe(F.col(i)) & (_mark(t) == F.col(m))
    left = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(twice, same).groupBy(i, m).agg(F.first(F.struct(*(F.col(c) for c in docs.columns))).alias(r)).select(f"{r}.*")
    return left.join(twice, same, "left_anti").unionByName(once)


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return report(table(spark, sf_dir, "documents")).drop("mark")
