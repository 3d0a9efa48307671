"""Phrase collocations by hierarchical pair naming.

A frequent word has an id. A frequent phrase of k words gets one for the pair of the ids of its first and its last k - 1
words, which overlap in all but one word each; the pairs are counted and named over the whole corpus. So a position holds
one number at every level, and the pair behind an id leads to all first and last parts of a phrase: the cuts read their
counts there, and what stands inside a longer phrase is found as the parent of one.

Texts are gathered to blocks of about ``BLOCK_BYTES`` in one language, which hold words, and later phrases, by numbers of
their own. A block counts its pairs and deals them into ranges by their hash, a packed row for each range. A range joins
what all blocks have of its pairs (about ``RANGE_PAIRS`` rows; one pair has at most one from each block), names the frequent
ones, and answers every block that asked. A block numbers its phrases in the order of their ids, so its pairs lie in the order of a
range's pairs: first ids and answered ids rise, and their steps take few bits. A frequent phrase has only frequent parts, so places without any fall out of the
blocks as they go. Every level is a checkpoint in the shared folder; counts are exact, and scores use decimals of 38 digits.

Edge cases: null texts have no words; a null language is ``und``; repeated rows count again; ties are broken by the
bytes of the phrase; an empty table gives no rows; other columns are ignored. Words are what stands between spaces and
tabs, whatever it is; a document of any length is spread over batches, not blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, query, table, text_of
from tidegauge.plans.checkpoints import release

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language that are returned.
LONGEST, SUPPORT, FIRST = 4, 30, 2_000
#: Percentage of a phrase's occurrences within one longer candidate from which on it is dropped.
WITHIN = 80
#: Score of a phrase whose parts occur nowhere else.
SCALE = 1_000_000
#: Bytes of text in a block, about; bytes that are cut into words at once.
BLOCK_BYTES, CUT_BYTES = 1 << 25, 1 << 20
#: Pairs (or words) of blocks that a range joins, about.
RANGE_PAIRS = 250_000
#: Level of compression of what blocks and ranges send each other.
SQUEEZE = 7
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
_BREAK = -1

def _pack(a: np.ndarray, kind=np.int32) -> bytes:
    """Numbers as planes of their bytes, compressed: the high bytes of small or slowly rising numbers take next to nothing."""
    wide = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(a, dtype=kind).view(np.uint8).reshape(-1, wide).T.tobytes(), SQUEEZE)


def _unpack(b: bytes, kind=np.int32) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def _pack_rising(a: np.ndarray, kind=np.int32) -> bytes:
    return _pack(np.diff(a, prepend=0), kind)


def _unpack_rising(b: bytes, kind=np.int32) -> np.ndarray:
    return np.cumsum(_unpack(b, kind), dtype=np.int64)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in text.split(", "))])


#: Blocks of words, and of pairs of ids; n is the number of different ones.
WORDS = "block long, lang string, n_words long, n long, words binary, freq binary, seq binary"
PAIRS = "block long, lang string, n long, gids binary, left binary, right binary, freq binary, seq binary"
#: What a block has in a range: its numbers, their keys (words, or pairs of ids) and counts.
ASKED = "range long, block long, lang string, at binary, words binary, left binary, right binary, freq binary"
#: What a range answers: its frequent keys by id, with the block and number where a word can be read; or the ids for the numbers of one block.
ANSWERS = "block long, at binary, ids binary, id array<long>, a array<long>, left array<long>, right array<long>, lang array<string>, word array<string>"


class Words:
    """The words of one language in a block: a number for each different one, and the numbers in order with breaks between pieces."""

    def __init__(self):
        self.codes: defaultdict = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[b""], self.codes[b"\n"] = 0, 1
        self.parts: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        """Texts are lower-cased from A to Z only, as bytes."""
        plain = b"\n".join(texts).lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.codes.__getitem__, plain), dtype=np.int32, count=len(plain))
        codes = codes[codes > 0] - 2
        self.parts += [codes, np.array([_BREAK], dtype=np.int32)]

    def row(self, block: int, lang: str) -> tuple:
        seq = np.concatenate(self.parts)
        freq = np.bincount(seq[seq >= 0], minlength=len(self.codes) - 2)
        return block, lang, int(freq.sum()), len(freq), zstandard.compress(b"\n".join(list(self.codes)[2:]), SQUEEZE), _pack(freq), _pack(squeezed(seq))


def squeezed(seq: np.ndarray) -> np.ndarray:
    """The sequence with one break wherever there are any, and without numbers that have no neighbour."""
    seq = np.concatenate([[_BREAK], seq, [_BREAK]]).astype(np.int32)
    alone = (seq[1:-1] >= 0) & (seq[:-2] < 0) & (seq[2:] < 0)
    seq[1:-1][alone] = _BREAK
    return seq[1:][(seq[1:] >= 0) | (seq[:-1] >= 0)]


def pairs_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the different neighbours, and the sequence of their numbers."""
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    width = int(seq.max(initial=0)) + 1
    keys, codes, n = np.unique(seq[:-1][both].astype(np.int64) * width + seq[1:][both], return_inverse=True, return_counts=True)
    out = np.full(len(both), _BREAK, dtype=np.int32)
    out[both] = codes
    return keys // width, keys % width, n, squeezed(out)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = _schema(fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to blocks of words."""
    block, held = TaskContext.get().partitionId() << 32, 0
    by: defaultdict[str, Words] = defaultdict(Words)

    def rows() -> list[tuple]:
        return [w.row(block + i, lang) for i, (lang, w) in enumerate(by.items())]

    for batch in batches:
        waiting: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting[lang].append(text)
            size += len(text) + 1
            if size >= CUT_BYTES:
                for k, v in waiting.items():
                    by[k].add(v)
                waiting.clear()
                held, size = held + size, 0
                if held >= BLOCK_BYTES:
                    for r in rows():
                        yield _batch([r], WORDS)
                    block, held = block + len(by), 0
                    by.clear()
        for k, v in waiting.items():
            by[k].add(v)
        held += size
    for r in rows():
        yield _batch([r], WORDS)


def _next_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, seq, found): numbers that have an id stay, the others are breaks; what is left is paired."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, lang, seq, found = (batch.column(c)[i].as_py() for c in ("block", "lang", "seq", "found"))
            seq = _unpack(seq)
            at, gids = np.concatenate([_unpack_rising(f["at"]) for f in found]), np.concatenate([_unpack_rising(f["ids"], np.int64) for f in found])
            order = np.argsort(gids)
            at, gids = at[order], gids[order]
            own = np.full(max(int(seq.max(initial=-1)), int(at.max(initial=-1))) + 2, _BREAK, dtype=np.int32)
            own[at] = np.arange(len(at))
            left, right, n, seq = pairs_of(own[seq])  # a break is -1, and so the last of own, which is a break
            if len(n):
                yield _batch([(block, lang, len(n), _pack_rising(gids, np.int64), _pack_rising(left), _pack(right), _pack(n), _pack(seq))], PAIRS)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of ids."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _asking(ranges: int, words: bool):
    """Blocks to a packed row for each range that they have something of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n = _unpack(row["freq"])
                if not len(n):
                    continue
                if words:
                    keys = np.array(zstandard.decompress(row["words"]).split(b"\n"), dtype=object)
                    seed = xxhash.xxh3_64_intdigest(row["lang"].encode()) & 0xFFFFFFFF
                    of = np.array([xxhash.xxh3_64_intdigest(w, seed) % ranges for w in keys.tolist()], dtype=np.int64)
                else:
                    gids = _unpack_rising(row["gids"], np.int64)
                    left, right = gids[_unpack_rising(row["left"])], gids[_unpack(row["right"])]
                    of = (_mixed(left, right) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(of, kind="stable")  # by range, and by number in it
                of = of[order]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
                out = []
                for x, y in zip(starts, np.r_[starts[1:], len(of)], strict=True):
                    at = order[x:y]
                    body = (zstandard.compress(b"\n".join(keys[at].tolist()), SQUEEZE), None, None) if words else (None, _pack_rising(left[at], np.int64), _pack(right[at], np.int64))
                    out.append((int(of[x]), row["block"], row["lang"], _pack_rising(at), *body, _pack(n[at])))
                    if len(out) == 256:
                        yield _batch(out, ASKED)
                        out = []
                if out:
                    yield _batch(out, ASKED)

    return run


def _naming(support: int, words: bool):
    """All rows of one range to its frequent keys and the answers to the blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = [r for b in table.to_batches() for r in zip(*(b.column(c).to_pylist() for c in ("range", "block", "lang", "at", "words", "left", "right", "freq")), strict=True)]
        rows.sort(key=lambda r: r[1])
        at, n = [_unpack_rising(r[3]) for r in rows], [_unpack(r[7]) for r in rows]
        own = np.repeat(np.arange(len(rows)), [len(x) for x in at])
        at, n = np.concatenate(at), np.concatenate(n).astype(np.int64)
        if words:  # a block has one language
            texts = pa.array([w for r in rows for w in zstandard.decompress(r[4]).split(b"\n")], type=pa.binary())
            code = pc.dictionary_encode(texts)
            langs, lang = np.unique([r[2] for r in rows], return_inverse=True)
            key = code.indices.to_numpy().astype(np.int64) * len(langs) + lang[own]
            order = np.argsort(key, kind="stable")
            new = np.r_[True, key[order][1:] != key[order][:-1]]
        else:
            left, right = (np.concatenate([unpack(r[k], np.int64) for r in rows]) for k, unpack in ((5, _unpack_rising), (6, _unpack)))
            order = np.lexsort((right, left))
            new = np.r_[True, (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])]
        first = np.flatnonzero(new)
        a = np.add.reduceat(n[order], first)
        good = a >= support
        id_of = np.full(len(first), -1, dtype=np.int64)
        id_of[good] = (rows[0][0] << 32) + np.arange(int(good.sum()))
        ids = np.empty(len(at), dtype=np.int64)
        ids[order] = id_of[np.cumsum(new) - 1]
        out = []
        if good.any():
            where, none = order[first[good]], [None] * int(good.sum())
            if words:
                named = (none, none, [rows[i][2] for i in own[where].tolist()], [w.decode("utf-8") for w in texts.take(pa.array(where)).to_pylist()])
            else:
                named = (left[where], right[where], none, none)
            out.append((None, None, None, id_of[good], a[good], *named))
        ends = np.cumsum(np.bincount(own, minlength=len(rows)))
        for r, x, y in zip(rows, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            held = ids[x:y] >= 0
            if held.any():
                out.append((r[1], _pack_rising(at[x:y][held]), _pack_rising(ids[x:y][held], np.int64), *[None] * 6))
        return pa.Table.from_batches([_batch(out, ANSWERS)])

    return run


def _level(held: DataFrame, support: int) -> DataFrame:
    """Names for what all blocks hold, and the answers to them."""
    words = "words" in held.columns
    ranges = max(1, math.ceil((held.agg(F.sum("n")).first()[0] or 0) / RANGE_PAIRS))
    return cut(held.mapInArrow(_asking(ranges, words), ASKED).groupBy("range").applyInArrow(_naming(support, words), ANSWERS))


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, support: int = SUPPORT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length 1, 2, ... the frequent phrases.

    Columns: id, lang, phrase, last (its last word), a (occurrences), firsts and lasts (occurrences of its first and last 1, 2, ...
    words, itself the last); from two words on also left and right, the ids of its first and last part.
    """
    two = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))
    held = cut(two.filter(F.octet_length("text") > 0).mapInArrow(_word_blocks, WORDS))
    total = held.groupBy("lang").agg(F.sum("n_words").alias("n")).filter("n > 0")
    answers = _level(held, support)
    named = answers.select(F.explode(F.arrays_zip("id", "lang", "word", "a")).alias("x")).select("x.*")
    level = named.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"))
    levels = [level]
    for _ in range(2, longest + 1):
        found = answers.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("found"))
        release(docs.sparkSession)  # what the blocks have sent
        held = cut(held.select("block", "lang", "seq").join(found, "block").mapInArrow(_next_pairs, PAIRS))
        release(docs.sparkSession)  # the blocks of the level before, and what was joined to them
        answers = _level(held, support)
        named = answers.select(F.explode(F.arrays_zip("id", "left", "right", "a")).alias("x")).select("x.*")
        level = cut(_named(named, level))
        levels.append(level)
        release(docs.sparkSession)  # the files of the level before
    return total, levels


def _named(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases from pairs of the ids of shorter ones."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_first"), "firsts")
    right = parts.select(F.col("id").alias("right"), "last", "lasts")
    both = pairs.join(left, "left").join(right, "right")  # a part may begin any share of the phrases: adaptive execution splits it
    longer = lambda c: F.concat(c, F.array("a"))
    return both.select("id", "lang", F.concat_ws(" ", "_first", "last").alias("phrase"), "last", "a", longer("firsts").alias("firsts"), longer("lasts").alias("lasts"), "left", "right")


def candidates(levels: list[DataFrame], within: int = WITHIN) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one holds nearly always.

    A phrase within a longer one is within one that is longer by a word, which is at least as frequent; so it is enough to
    look at the phrases whose first or last part it is.
    """
    exact = lambda x: x.cast("decimal(38,0)")
    out = []
    for k, level in enumerate(levels[1:], start=2):
        if k < len(levels):
            longer = levels[k]
            most = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("_b")).groupBy("id").agg(F.max("_b").alias("_b"))
            level = level.join(most, "id", "left").filter(F.col("_b").isNull() | (exact(F.col("_b")) * 100 < exact(F.col("a")) * within))
        cuts = []
        for j in range(1, k):
            first, rest = F.col("firsts")[j - 1], F.col("lasts")[k - j - 1]
            score = F.expr(f"cast({2 * SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(firsts[{j - 1}] as decimal(20,0)) + cast(lasts[{k - j - 1}] as decimal(20,0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("j"), first.alias("l"), rest.alias("r")))
        best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        out.append(level.withColumn("_best", best).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, support: int = SUPPORT, within: int = WITHIN, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by score, occurrences and bytes."""
    total, levels = phrases(docs, lang, text, longest, support)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(levels, within).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, k WHERE len(ws) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT x.lang, x.k, x.g, x.a, y.a AS l, z.a AS r, j, (2000000::HUGEINT * x.a) // (y.a + z.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) x
  JOIN f y ON y.lang = x.lang AND y.g = x.g[1:j]
  JOIN f z ON z.lang = x.lang AND z.g = x.g[j + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_of AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS b
  FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
s AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score::BIGINT AS score
  FROM b LEFT JOIN inner_of i ON i.lang = b.lang AND i.g = b.g WHERE i.b IS NULL OR 100 * i.b::HUGEINT < 80 * b.a::HUGEINT),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""


@query("op13_collocation", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
