"""SimHash fingerprints, near-duplicate search by bands, clusters of scripts, and set similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import md5
from itertools import combinations, product
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidegauge.functions import text as T
from tidegauge.operators import near_links as N
from tidegauge.operators import set_join
from tidegauge.operators.joins import small
from tidegauge.plans.checkpoints import cut
from tidegauge.plans.skew import components
from tidegauge.plans.views import view
from tidegauge.registry import query, table

BITS = 64
#: Variants of the features: characters kept after lower-casing, gram width, and whether repeats count.
VARIANTS = {"crawl": (r"[^a-z0-9_]", 3, True), "notebook": (r"[^\w]+", 3, True), "library": (r"[^\w]+", 4, True), "distinct": (r"[^\w]+", 4, False)}


def features(text: Column, variant: str = "crawl") -> Column:
    drop, width, repeats = VARIANTS[variant]
    text = F.coalesce(text, F.lit(""))
    # the crawl variant drops everything but ASCII letters, digits and blanks first, then the blanks
    t = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")), r"[^a-z0-9]", "") if variant == "crawl" else F.regexp_replace(F.lower(text), drop, "")
    g = T.ngrams(t, width)
    return g if repeats else F.array_distinct(g)


def feature_hash(gram: Column) -> Column:
    """The last 64 bits of the MD5."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 17, 16), 16, -10).cast("bigint")


_LANE = 32  # two counters share a sum: bit i in its lower half, bit i + 32 in its upper
_LANES = 1 << _LANE | 1


def fingerprint(df: DataFrame, key: str, text: str, variant: str = "crawl") -> DataFrame:
    """(key, simhash) in SQL functions: a bit is set when more than half of the features set it.

    Features are counted within their row before the bits are, so a repeated gram is hashed once, and what is shuffled is
    a row of sums for each key. A text has less than 2^31 grams.
    """
    s = df.select(key, F.sort_array(features(F.col(text), variant)).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    runs = s.select(key, "s", first.alias("first"))
    counted = F.transform("first", lambda i, k: F.struct(F.get("s", i).alias("g"), (F.coalesce(F.get("first", k + 1), F.size("s")) - i).alias("w")))
    rows = runs.select(key, F.inline(counted)).withColumn("h", feature_hash(F.col("g")))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES).cast("bigint")) * F.col("w")).alias(f"b{i}") for i in range(_LANE)]
    counted = rows.groupBy(key).agg(F.sum("w").alias("n"), *sums)
    out = F.lit(0).cast("bigint")
    for i in range(_LANE):
        low, high = F.col(f"b{i}").bitwiseAND(F.lit((1 << _LANE) - 1).cast("bigint")), F.shiftrightunsigned(f"b{i}", _LANE)
        for n, bit in ((low, i), (high, i + _LANE)):
            out = out.bitwiseOR(F.when(n * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
    return counted.select(key, out.alias("simhash"))


_SIGNS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_OTHERS = bytes(set(range(256)) - set(_SIGNS + _SIGNS.upper()))
_VALUE = np.zeros(256, dtype=np.int32)
for _i, _c in enumerate(_SIGNS):
    _VALUE[_c] = _VALUE[_SIGNS.upper()[_i]] = _i


@cache
def _gram_bits() -> np.ndarray:
    """The bits of all 36^3 grams of the crawl variant as bytes, eight to a word: words of up to 255 grams add up without a carry."""
    raw = b"".join(md5(bytes(g)).digest()[8:] for g in product(_SIGNS, repeat=3))
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).view(np.uint64)


def print_of(text: bytes) -> int:
    """The crawl variant's fingerprint of one text in UTF-8."""
    plain = text.translate(None, _OTHERS)
    if len(plain) < 3:
        return int.from_bytes(md5(plain.lower()).digest()[8:], "big", signed=True)
    c = _VALUE[np.frombuffer(plain, dtype=np.uint8)]
    grams, held = (c[:-2] * 36 + c[1:-1]) * 36 + c[2:], _gram_bits()
    sums = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(grams), 255):
        sums += np.add.reduce(held[grams[lo : lo + 255]], axis=0).view(np.uint8)
    return int(np.packbits(sums * 2 > len(grams)).view(">i8")[0])


@F.arrow_udf(LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    """The crawl variant text by text, for long texts: nothing is exploded, and no gram is hashed twice by a worker."""
    return pa.array([print_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.int64())


def bands(k: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(offset, width) of k + 1 bands from the lowest bit; the last takes the rest."""
    step = bits // (k + 1)
    return [(i * step, step if i < k else bits - i * step) for i in range(k + 1)]


#: Pieces that hashes may be cut into.
PIECES = range(1, 21)


def plan_pieces(k: int, n: int, bits: int = BITS) -> int:
    """Into how many pieces to cut n hashes: the number with the fewest rows to make and to compare.

    With distance at most k, m - k of m pieces are equal, so there is a key for each choice of m - k pieces: few short
    keys suit few hashes, many long ones suit many.
    """
    cost = {}
    for m in PIECES:
        if m > k:
            keys = comb(m, k)
            cost[m] = keys * n * (1 + n / 2 ** (bits * (m - k) / m))
    return min(cost, key=cost.__getitem__)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _choices(k: int, m: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Masks of m pieces, and each choice of m - k of them as the bits of its pieces and its mask."""
    masks = [((1 << w) - 1) << o for o, w in bands(m - 1)]
    return masks, [(sum(1 << i for i in c), _signed(sum(masks[i] for i in c))) for c in combinations(range(m), m - k)]


def piece_keys(hashes: DataFrame, k: int, m: int) -> DataFrame:
    """(choice, v, simhash) for every choice of m - k of m pieces: hashes within distance k have a choice with equal values."""
    chosen = _choices(k, m)[1]

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            h = b["simhash"].to_numpy(dtype=np.int64)
            for lo in range(0, len(chosen), 64):
                some = chosen[lo : lo + 64]
                yield pd.DataFrame({"choice": np.repeat([c for c, _ in some], len(h)), "v": np.concatenate([h & np.int64(mask) for _, mask in some]), "simhash": np.tile(h, len(some))})

    return hashes.select("simhash").mapInPandas(keys, "choice long, v long, simhash long")


#: Hashes of a sample by which :func:`plan_pairs` tells how crowded the buckets of pieces are; keys of a hash at most.
SAMPLE, MOST_KEYS = 4_096, 2_000
#: Costs in microseconds, about: a row for a key of pieces, a pair that a join of them makes, a pair that is compared in a block.
KEY_COST, PAIR_COST, BLOCK_COST = 2.0, 0.05, 0.0025
#: Hashes of a block at most and at least, the blocks that are wanted, and hashes of two blocks that meet at once. A hash is sent once for each block.
BLOCK, LEAST_BLOCK, BLOCKS, STRIP, TILE = 1 << 20, 1 << 11, 12, 16, 1 << 15


def plan_pairs(sample: np.ndarray, n: int, k: int) -> int | None:
    """Into how many pieces to cut n hashes so that their near pairs are found soonest, or None if comparing all of them is sooner.

    Hashes of like texts are like: the share of pairs that meet in a bucket is taken from a sample of the hashes, and not from
    evenly spread ones. For few bits of many hashes, pieces make a small part of all pairs; for many bits a pair may meet in so many
    choices that they make more than there are. The result doesn't depend on the plan.
    """
    best, out = n * n / 2 * BLOCK_COST, None
    share = n * (n - 1) / max(1, len(sample) * (len(sample) - 1))
    for m in PIECES:
        if m > k and comb(m, k) <= MOST_KEYS and comb(m, k) * n * KEY_COST < best:
            met = sum(int((c * (c - 1) // 2).sum()) for _, mask in _choices(k, m)[1] for c in [np.unique(sample & np.int64(mask), return_counts=True)[1]])
            cost = comb(m, k) * n * KEY_COST + met * share * PAIR_COST
            if cost < best:
                best, out = cost, m
    return out


def near_pairs(hashes: DataFrame, key: str, k: int, pieces: int | None = None) -> DataFrame:
    """Pairs (ha, hb, distance, a, b) of different hashes with Hamming distance at most k; a and b are the smallest keys that have them.

    Equal hashes are one candidate: their members are found by the smallest key (:func:`members`). Hashes meet by pieces, or
    where that would make more pairs than there are, in blocks (:func:`plan_pairs`).
    """
    distinct = cut(hashes.groupBy("simhash").agg(F.min(key).alias("rep")))
    n = distinct.count()
    if not pieces:
        drawn = distinct.select("simhash").filter(F.pmod(F.xxhash64("simhash", F.lit(3)), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE)
        pieces = plan_pairs(np.array([r[0] for r in drawn.collect()], dtype=np.int64), n, k)
    return _pairs_by_pieces(distinct, k, pieces) if pieces else _pairs_by_blocks(distinct, k, n)


def block_count(n: int) -> int:
    """Blocks of n hashes: as many rows of each hash are shuffled."""
    return max(-(-n // BLOCK), min(BLOCKS, -(-n // LEAST_BLOCK)), 1)


def _pairs_by_blocks(distinct: DataFrame, k: int, n: int) -> DataFrame:
    """The near pairs of n different hashes (simhash, rep): each two blocks of them are compared in full, a few rows at once."""
    blocks = block_count(n)
    kind = distinct.schema["rep"].dataType

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        own, h, rep = t.column("block").to_numpy(), t.column("simhash").to_numpy().view(np.uint64), t.column("rep").combine_chunks()
        i, j = (x.as_py() for x in key)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        against = h[right]
        for lo in range(0, len(left), STRIP):
            some = left[lo : lo + STRIP]
            for first in range(lo if i == j else 0, len(right), TILE):  # a block with itself: from the row on
                a, b = np.nonzero(np.bitwise_count(h[some][:, None] ^ against[first : first + TILE]) <= k)
                a, b = some[a], right[b + first]
                if i == j:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    swap = h[a].view(np.int64) > h[b].view(np.int64)
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    columns = [h[a].view(np.int64), h[b].view(np.int64), np.bitwise_count(h[a] ^ h[b]).astype(np.int32), rep.take(pa.array(a)), rep.take(pa.array(b))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ha", "hb", "distance", "a", "b"])

    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("simhash"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "simhash", "rep")
    rep = kind.simpleString()
    return met.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(run, f"ha long, hb long, distance int, a {rep}, b {rep}")


def _pairs_by_pieces(distinct: DataFrame, k: int, m: int) -> DataFrame:
    """The near pairs of different hashes (simhash, rep) that are cut into m pieces.

    By the pigeonhole principle a pair agrees in m - k of m pieces, and is made for the first m - k of those that it
    agrees in only.
    """
    masks, chosen = _choices(k, m)

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            h = b["simhash"].to_numpy(dtype=np.int64)
            for lo in range(0, len(chosen), 64):
                some = chosen[lo : lo + 64]
                yield pd.DataFrame({"choice": np.repeat([c for c, _ in some], len(h)), "v": np.concatenate([h & np.int64(mask) for _, mask in some]), "h": np.tile(h, len(some)), "rep": np.tile(b["rep"].to_numpy(), len(some))})

    rep = distinct.schema["rep"].dataType.simpleString()
    rows = distinct.mapInPandas(keys, f"choice long, v long, h long, rep {rep}")
    a, b = rows.select("choice", "v", F.col("h").alias("ha"), F.col("rep").alias("a")), rows.select("choice", "v", F.col("h").alias("hb"), F.col("rep").alias("b"))
    both = F.col("ha").bitwiseXOR(F.col("hb"))
    equal = F.lit(0).cast("bigint")
    for i, mask in enumerate(masks):
        equal = equal + F.when(both.bitwiseAND(F.lit(_signed(mask)).cast("bigint")) == 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    found = a.join(b, ["choice", "v"]).filter((F.col("ha") < F.col("hb")) & (F.bit_count(both) <= k)).withColumn("equal", equal)
    # the lowest m - k pieces that are equal are the choice: none that is equal stands below its highest piece and isn't chosen
    high = F.pow(F.lit(2.0), F.floor(F.log2("choice")) + 1).cast("bigint") - 1
    first = F.col("equal").bitwiseAND(high) == F.col("choice")
    return found.filter(first).select("ha", "hb", F.bit_count(both).alias("distance"), "a", "b")


def free_bits(k: int, m: int) -> dict[int, list[int]]:
    """The bits that each choice of m - k of m pieces leaves open."""
    return {c: [b for b in range(BITS) if not mask >> b & 1] for c, mask in _choices(k, m)[1]}


def near_links(hashes: DataFrame, k: int, pieces: int | None = None) -> DataFrame:
    """Links (a, b) between near hashes: fewer than the near pairs, with the same clusters (:mod:`near_links`)."""
    distinct = cut(hashes.select("simhash").distinct())
    n = distinct.count()
    m = pieces or plan_pieces(k, n)
    return N.links(piece_keys(distinct, k, m), free_bits(k, m), k, n * comb(m, k))


def members(hashes: DataFrame, key: str) -> DataFrame:
    """(key, rep): every key with the smallest one of its hash, by which pairs name it."""
    return hashes.join(hashes.groupBy("simhash").agg(F.min(key).alias("rep")), "simhash").select(key, "rep")


def clusters(hashes: DataFrame, key: str, k: int) -> DataFrame:
    """(key, cluster): transitive clusters of near hashes, named by their smallest key; singletons too."""
    roots = components(near_links(hashes, k)).withColumnRenamed("node", "simhash")
    own = hashes.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    names = own.groupBy("root").agg(F.min(key).alias("cluster"))
    return own.join(names, "root").select(key, "cluster")


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The index with new entries added; an entry with a known key replaces the old one."""
    return index.join(new, key, "left_anti").unionByName(new)


def delete(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return index.join(keys, key, "left_anti")


def bucket_stats(hashes: DataFrame, k: int, warn: int = 200) -> DataFrame:
    """(band, buckets, largest, crowded): how the distinct hashes spread over the buckets of each band."""
    value = lambda o, w: F.shiftrightunsigned("simhash", o).bitwiseAND(F.lit((1 << w) - 1).cast("bigint"))
    rows = hashes.select("simhash").distinct().select(F.posexplode(F.array(*(value(o, w) for o, w in bands(k)))).alias("band", "v"))
    n = rows.groupBy("band", "v").agg(F.count("*").alias("n"))
    return n.groupBy("band").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.count_if(F.col("n") > warn).alias("crowded"))


def jaccard_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """Exact Jaccard similarity of token sets, for all pairs (a, b) of keys that reach ``least``: different sets are paired once (:mod:`set_join`), then their copies."""
    return set_join.all_pairs(set_join.set_pairs(df, key, tokens, least), set_join.members(df, key, tokens), key)


#: Modulus of the hash functions, a prime.
PRIME = (1 << 31) - 1


def coefficients(n: int) -> list[tuple[int, int]]:
    """(a, b) of n functions h -> (a h + b) mod PRIME, drawn by powers of a primitive root."""
    return [(pow(16807, 2 * i + 1, PRIME), pow(16807, 2 * i + 2, PRIME)) for i in range(n)]


def minhash(df: DataFrame, key: str, tokens: str, n: int = 128) -> DataFrame:
    """(key, signature): the smallest value of each of n hash functions over the tokens, whose own hash is taken from their MD5."""
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 7), 16, 10).cast("bigint")
    rows = df.select(key, F.explode(F.array_distinct(tokens)).alias("t")).select(key, h.alias("h"))
    return rows.groupBy(key).agg(F.array(*(F.min((F.col("h") * a + b) % PRIME) for a, b in coefficients(n))).alias("signature"))


def dbscan(pairs: DataFrame, points: DataFrame, key: str, least: int = 5, weight: str | None = None) -> DataFrame:
    """(key, cluster) from neighbour pairs (a, b) within eps: core points have ``least`` neighbours, themselves among them; border points join their smallest core's cluster; noise is null.

    A point counts for as many as its ``weight`` says (a column of ``points``), else for one.
    """
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    if weight:
        own = points.select(F.col(key).alias("b"), F.col(weight).alias("w"))
        around = both.join(own, "b").groupBy("a").agg(F.sum("w").alias("n"))
        counted = own.withColumnRenamed("b", "a").join(around, "a", "left").select("a", (F.col("w") + F.coalesce("n", F.lit(0))).alias("n"))
    else:
        counted = both.groupBy("a").agg((F.count("*") + 1).alias("n"))
    core = cut(counted.filter(F.col("n") >= least).select(F.col("a").alias("core")))
    inner = both.join(core, both.a == core.core, "left_semi").join(core, both.b == core.core, "left_semi")
    roots = components(inner)
    named = core.join(roots.withColumnRenamed("node", "core"), "core", "left").select("core", F.coalesce("root", "core").alias("cluster"))
    border = both.join(core, both.a == core.core, "left_anti").join(named, F.col("b") == F.col("core")).groupBy("a").agg(F.min_by("cluster", "core").alias("cluster"))
    return points.select(key).join(named.select(F.col("core").alias(key), "cluster").unionByName(border.select(F.col("a").alias(key), "cluster")), key, "left")


def members_wide(clusters_: DataFrame, cluster: str, member: str, n: int) -> DataFrame:
    """Export form: size and the first n members in columns."""
    g = clusters_.groupBy(cluster).agg(F.count("*").alias("cluster_size"), F.array_sort(F.collect_set(member)).alias("_m"))
    return g.select(cluster, "cluster_size", *(F.get("_m", F.lit(i)).alias(f"cluster_{i + 1}") for i in range(n)))


_GRAMS = "SELECT doc_id, unnest(list_transform(range(greatest(length(t) - 2, 1)), lambda i: substr(t, i::INT + 1, 3))) AS g FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')), '[^a-z0-9]', '', 'g') AS t FROM documents) x"
_PRINTS = f"""h AS (SELECT doc_id, ('0x' || md5(g)[17:])::UBIGINT AS h FROM ({_GRAMS}) y),
    f AS (SELECT doc_id, ({" + ".join(f"(CASE WHEN count(*) FILTER ((h >> {i}) & 1 = 1) * 2 > count(*) THEN {1 << i} ELSE 0 END)::HUGEINT" for i in range(BITS))}) AS u FROM h GROUP BY doc_id),
    p AS (SELECT doc_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS simhash FROM f)"""


def _prints(s, d):
    return fingerprint(table(s, d, "documents"), "doc_id", "text")


@query("sh_fingerprint", f"WITH {_PRINTS} SELECT doc_id, simhash FROM p")
def _(s, d):
    return _prints(s, d)


@query("sh_fingerprint_udf", f"WITH {_PRINTS} SELECT doc_id, simhash FROM p")
def _(s, d):
    return table(s, d, "documents").select("doc_id", fingerprint_udf("text").alias("simhash"))


def _fast(s, d):
    return cut(table(s, d, "documents").select("doc_id", fingerprint_udf("text").alias("simhash")))


@query("sh_distance", f"WITH {_PRINTS} SELECT doc_id, bit_count(xor(simhash, (SELECT simhash FROM p WHERE doc_id = 0)))::INT AS distance FROM p")
def _(s, d):
    p = _fast(s, d)
    one = p.filter("doc_id = 0").select(F.col("simhash").alias("x"))
    return p.crossJoin(F.broadcast(one)).select("doc_id", T.hamming(F.col("simhash"), F.col("x")).alias("distance"))


_NEAR = f"WITH {_PRINTS}, u AS (SELECT simhash, min(doc_id) AS rep FROM p GROUP BY simhash), n AS (SELECT a.simhash AS ha, b.simhash AS hb, bit_count(xor(a.simhash, b.simhash))::INT AS distance, a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 2)"


@query("sh_near_dups", f"{_NEAR} SELECT * FROM n")
def _(s, d):
    return near_pairs(_fast(s, d), "doc_id", 2)


@query("sh_near_dups_k8", _NEAR.replace("<= 2", "<= 8") + " SELECT * FROM n")
def _(s, d):
    return near_pairs(_fast(s, d), "doc_id", 8)


@query("sh_members", f"WITH {_PRINTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS rep FROM p")
def _(s, d):
    return members(_fast(s, d), "doc_id")


@query("sh_index_add", f"WITH {_PRINTS} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 7 ELSE simhash END AS simhash FROM p WHERE doc_id % 10 <> 3")
def _(s, d):
    p = _fast(s, d)
    new = p.filter("doc_id % 10 = 0").select("doc_id", F.lit(7).cast("bigint").alias("simhash"))
    return delete(upsert(p, new, "doc_id"), p.filter("doc_id % 10 = 3"), "doc_id")


_BUCKETS = " UNION ALL ".join(f"SELECT {i} AS band, (u >> {o}) & {(1 << w) - 1} AS v FROM u" for i, (o, w) in enumerate([(0, 21), (21, 21), (42, 22)]))


@query("sh_bucket_stats", f"WITH {_PRINTS}, u AS (SELECT DISTINCT simhash AS u FROM p), b AS (SELECT band, v, count(*) AS n FROM ({_BUCKETS}) x GROUP BY band, v) SELECT band, count(*) AS buckets, max(n) AS largest, count(*) FILTER (n > 200) AS crowded FROM b GROUP BY band")
def _(s, d):
    return bucket_stats(_fast(s, d), 2)


_CC = f"""WITH RECURSIVE {_NEAR[5:]}, e AS (SELECT ha AS x, hb AS y FROM n UNION SELECT hb, ha FROM n UNION SELECT simhash, simhash FROM u),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT p.doc_id, (SELECT min(q.doc_id) FROM r JOIN p q ON q.simhash = r.y WHERE r.x = p.simhash) AS cluster FROM p)"""


@query("cc_clusters", f"{_CC} SELECT doc_id, cluster FROM c")
def _(s, d):
    return clusters(_fast(s, d), "doc_id", 2)


@query("cluster_rows", f"{_CC} SELECT cluster, count(*) AS cluster_size, list(doc_id ORDER BY doc_id) AS members FROM c GROUP BY cluster")
def _(s, d):
    return clusters(_fast(s, d), "doc_id", 2).groupBy("cluster").agg(F.count("*").alias("cluster_size"), F.array_sort(F.collect_list("doc_id")).alias("members"))


@query("cluster_size_histogram", f"{_CC} SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM c GROUP BY cluster) x GROUP BY size")
def _(s, d):
    return clusters(_fast(s, d), "doc_id", 2).groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("flatten_cluster_export", "SELECT cluster, count(DISTINCT hash) AS cluster_size, list(DISTINCT hash ORDER BY hash)[1] AS cluster_1, list(DISTINCT hash ORDER BY hash)[2] AS cluster_2 FROM mem GROUP BY cluster")
def _(s, d):
    return members_wide(view(s, d, "mem").select("cluster", "hash").distinct(), "cluster", "hash", 2)


_TOKENS = "SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS s FROM documents"


def _tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "").alias("s"))


_JACCARD = f"WITH t AS ({_TOKENS}) SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6)::DOUBLE AS jaccard FROM t a JOIN t b ON a.doc_id < b.doc_id AND least(len(a.s), len(b.s)) >= 0.8 * greatest(len(a.s), len(b.s)) WHERE len(a.s) > 0 AND jaccard >= 0.8"


@query("mh_minhash_jaccard", _JACCARD)
def _(s, d):
    return jaccard_pairs(_tokens(s, d), "doc_id", "s", 0.8).withColumn("jaccard", F.round("jaccard", 6))


_HASHES = ", ".join(f"min((h * {a} + {b}) % {PRIME})" for a, b in coefficients(128))


@query("mh_signature", f"SELECT doc_id, [{_HASHES}] AS signature FROM (SELECT doc_id, ('0x' || md5(unnest(s))[1:7])::BIGINT AS h FROM ({_TOKENS}) t) x GROUP BY doc_id")
def _(s, d):
    return minhash(_tokens(s, d), "doc_id", "s")


@query(
    "db_dbscan",
    f"""WITH RECURSIVE {_JACCARD[5:].replace(" SELECT a.doc_id AS a", ", j AS (SELECT a.doc_id AS a", 1)}), e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), core AS (SELECT a AS c FROM e GROUP BY a HAVING count(*) >= 4),
    r(x, y) AS (SELECT c, c FROM core UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a JOIN core ON core.c = e.b), named AS (SELECT x AS c, min(y) AS cluster FROM r GROUP BY x),
    border AS (SELECT e.a AS doc_id, arg_min(cluster, named.c) AS cluster FROM e JOIN named ON e.b = named.c WHERE e.a NOT IN (SELECT c FROM core) GROUP BY e.a)
    SELECT doc_id, coalesce(named.cluster, border.cluster, -1) AS cluster FROM documents LEFT JOIN named ON doc_id = named.c LEFT JOIN border USING (doc_id)""",
)
def _(s, d):
    # copies of a set have the same neighbours, so one of them stands for all and counts for as many
    held = cut(set_join.members(_tokens(s, d), "doc_id", "s"))
    points = held.groupBy("rep").agg(F.count("*").alias("w"))
    found = cut(dbscan(set_join.set_pairs(_tokens(s, d), "doc_id", "s", 0.8), points, "rep", weight="w").filter("cluster IS NOT NULL"))
    own = held.join(small(found), "rep").select("doc_id", "cluster")
    return table(s, d, "documents").select("doc_id").join(own, "doc_id", "left").fillna(-1)
