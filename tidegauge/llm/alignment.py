"""Alignment of the tokens of two tokenizers over the bytes of whole texts.

The ends of the tokens of A and of B are marked in two packed bitsets over the bytes. Their AND has the shared cuts, which
part the tokens into groups; popcounts of the words before a cut (rank) give the tokens on either side of it; the OR has
the ends of the links, since between two neighbouring ends there is exactly one token of A and one of B.

Neither tokenizer joins a space or line feed to what stands before it (checked for the given files), so a text is cut
there into chunks, each of which begins and ends at a shared cut (but for texts with B's mark for a space, which have no tokens). A block of about ``BLOCK_BYTES`` of texts encodes and
aligns every different chunk once; texts then only add up their chunks.

How many documents hold an id pair is counted for each block and summed over blocks; every block asks for the counts of
its own pairs and no others. What is broadcast has at most one row for each id of A. Blocks are kept in the shared folder.

Edge cases: null and empty texts, and texts whose token bytes aren't the text's after a space, have no tokens (zeros and an
empty digest); special tokens' strings are plain text; repeated rows and equal or null ids are documents of their own;
an empty table gives no rows; other columns are ignored. A tokenizer file for which chunks don't hold is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpe import _byte_letters, read_spec
from tidegauge.llm.common import cut, query, table

#: Bytes of text in a block, about; chunks that are aligned at once.
BLOCK_BYTES, CHUNKS = 1 << 24, 1 << 15
#: White space by any table of any library, besides the space and the line feed at which texts are cut.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_CHUNK = re.compile("[ \n]+[^ \n]*")
_CAREFUL_CHUNK = re.compile(f"[ \n](?:[^ \n]|(?<=[ \n]|{_OTHER_SPACE.pattern})[ \n])*")


def chunks_of(text: str) -> list[str]:
    """Parts of a text that begins with a space; each begins with a space or line feed behind another character than white space."""
    return (_CAREFUL_CHUNK if _OTHER_SPACE.search(text) else _CHUNK).findall(text)


def packed(ends: np.ndarray, size: int) -> np.ndarray:
    """A bitset of ``size`` bits in 64-bit words with the ends set."""
    marks = np.zeros(-(-size // 64) * 64, dtype=bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def ranks(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set below each place."""
    before = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[at >> 6] + np.bitwise_count(bits[at >> 6] & below)


def selected(bits: np.ndarray) -> np.ndarray:
    """The places of the set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """What :func:`align` finds: ends of the groups in tokens of A and of B, and for each link its byte end and tokens."""

    cuts: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    link_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Align two rows of tokens over the same bytes, given their sizes in bytes (none is 0, the sums are equal)."""
    a, b = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    n = int(a[-1]) + 1 if len(a) else 1
    x, y = packed(a, n), packed(b, n)
    cuts, ends = selected(x & y), selected(x | y)
    return Aligned(cuts, ranks(x, cuts) + 1, ranks(y, cuts) + 1, ends, ranks(x, ends), ranks(y, ends))


class Pair:
    """The two tokenizers with the bytes of every token."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a_spec)
        cutter = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space"):
            raise ValueError("A must be a byte-level BPE that is cut into words by its usual pattern")
        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        letters = {c: i for i, c in enumerate(_byte_letters())}
        names = {**{i: s for s, i in spec["model"]["vocab"].items()}, **{t["id"]: None for t in spec["added_tokens"]}}
        self.a_bytes = [b"" if names.get(i) is None else bytes(letters[c] for c in names[i]) for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or (len(p) > 1 and "\n" in p) for p in pieces):
            raise ValueError("B has pieces that run over a space or line feed")
        self.space = self.b.piece_to_id("▁")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if self.encode_b([" a\n", "\nb"]) != [self.b.encode("a\n"), self.b.encode("a\nb")[-len(self.b.encode("\nb")) + 1 :]]:
            raise ValueError("B changes white space")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.signs = [[np.array([f"{i}{s}" for i in range(len(t))], dtype=object) for s in (",", end)] for t, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """B puts a space in front: the chunk's own one goes, or a line feed's chunk is encoded behind a line feed and loses both."""
        ids = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        return [x if c[0] == " " and len(c) > 1 else [self.space] if c == " " else x[2:] for c, x in zip(chunks, ids, strict=True)]


@dataclass
class Chunks:
    """Counts of each chunk, the digits of its groups, and its links as id pairs (A's id times 2**32 plus B's)."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    signs: list[str]
    n_links: np.ndarray
    links: np.ndarray


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for x in lists for i in x), dtype=np.int64)


def align_chunks(pair: Pair, chunks: list[str]) -> Chunks:
    """Encode and align chunks, joined to one row of bytes."""
    a, b = pair.encode_a(chunks), pair.encode_b(chunks)
    raw = [c.encode("utf-8") for c in chunks]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    good = np.ones(len(chunks), dtype=bool)
    for ids, known in ((a, pair.a_bytes), (b, pair.b_bytes)):
        joined = [b"".join([known[i] for i in x]) for x in ids]
        good &= np.fromiter((x == y for x, y in zip(joined, raw, strict=True)), dtype=bool, count=len(raw))
    if not good.all():
        a, b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a, b))
        sizes[~good] = 0
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b))
    a, b = _flat(a), _flat(b)
    found = align(pair.a_sizes[a], pair.b_sizes[b])
    ends = np.cumsum(sizes)
    # a chunk ends at a shared cut, so counts up to it are those of the cuts and links up to its end
    groups, links = (np.diff(np.r_[0, np.searchsorted(at, ends, side="right")]) for at in (found.cuts, found.link_ends))
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[found.a_ends - 1] = last_b[found.b_ends - 1] = True
    signs = np.empty(len(a) + len(b), dtype=object)
    group_a, group_b = (np.repeat(np.arange(len(e)), np.diff(np.r_[0, e])) for e in (found.a_ends, found.b_ends))
    signs[np.arange(len(a)) + np.r_[0, found.b_ends][group_a]] = np.where(last_a, pair.signs[0][1][a], pair.signs[0][0][a])
    signs[np.arange(len(b)) + found.a_ends[group_b]] = np.where(last_b, pair.signs[1][1][b], pair.signs[1][0][b])
    signs, at = signs.tolist(), np.r_[0, np.cumsum(n_a + n_b)].tolist()
    return Chunks(good, n_a, n_b, groups, ["".join(signs[x:y]) for x, y in zip(at, at[1:], strict=False)], links, (a[found.link_a] << 32) | b[found.link_b])


def _ragged(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of each of the rows, one after the other; row i has sizes[i] values."""
    first, n = np.r_[0, np.cumsum(sizes)][rows], sizes[rows]
    return values[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


_SQUEEZE = zstandard.ZstdCompressor(level=1)


def _pack(a: np.ndarray, kind) -> bytes:
    return _SQUEEZE.compress(np.ascontiguousarray(a, dtype=kind).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


BLOCK_SCHEMA = "block long, doc_id array<long>, shas array<string>, stats binary, n_chunks binary, chunks binary, times binary, n_links binary, links binary, pairs array<long>, docs array<long>"
_BLOCK_TYPE = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("shas", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("stats", "n_chunks", "chunks", "times", "n_links", "links")]
    + [("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)


def make_block(pair: Pair, block: int, ids: list, lists: list[np.ndarray], chunks: list[str]) -> pa.RecordBatch:
    """One row for a block: its documents' counts and digests, their chunks, the chunks' links, and the documents that hold each pair."""
    parts = [align_chunks(pair, chunks[i : i + CHUNKS]) for i in range(0, len(chunks), CHUNKS)]
    join = lambda name: np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    good, n_links, signs = join("good").astype(bool), join("n_links"), [s for p in parts for s in p.signs]
    pairs, links = np.unique(join("links"), return_inverse=True)
    lists = [x if good[x].all() else x[:0] for x in lists]
    shas = [hashlib.sha256("".join([signs[c] for c in x.tolist()])[:-1].encode()).hexdigest() if len(x) else "" for x in lists]
    flat = np.concatenate([*lists, np.zeros(0, dtype=np.int64)])
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    stats = [np.zeros(len(lists), dtype=np.int64) for _ in range(4)]
    for total, name in zip(stats, ("n_a", "n_b", "n_groups", "n_links"), strict=True):
        np.add.at(total, doc, join(name)[flat])
    width = max(1, len(chunks))
    keys, times = np.unique(doc * width + flat, return_counts=True)
    doc, once = keys // width, keys % width
    held = np.unique(np.repeat(doc, n_links[once]) * max(1, len(pairs)) + _ragged(links, n_links, once))
    docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    row = [block, ids, shas, _pack(np.stack(stats, axis=1), np.int64), _pack(np.bincount(doc, minlength=len(lists)), np.int64), _pack(once, np.int32), _pack(times, np.int32), _pack(n_links, np.int32), _pack(links, np.int32), pairs, docs]
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _BLOCK_TYPE, strict=True)], schema=_BLOCK_TYPE)


_LOADED: dict[str, Pair] = {}


def _pair(a_spec: str, b_model: bytes) -> Pair:
    """One pair of tokenizers in a worker process."""
    key = hashlib.md5(a_spec.encode() + b_model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pair(a_spec, b_model)
    return _LOADED[key]


def blocks(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", size: int = 0) -> DataFrame:
    """Blocks of aligned documents (``BLOCK_SCHEMA``)."""
    with open(b_path, "rb") as f:
        given = docs.sparkSession.sparkContext.broadcast((read_spec(a_path), f.read()))
    most = size or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = _pair(*given.value), TaskContext.get().partitionId() << 32
        made = held = 0
        ids: list = []
        lists: list[np.ndarray] = []
        codes: defaultdict = defaultdict()
        codes.default_factory = codes.__len__
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                lists.append(np.array([codes[c] for c in chunks_of(" " + t)] if t else [], dtype=np.int64))
                held += len(t or "") + 64
                if held >= most:
                    yield make_block(pair, first + made, ids, lists, list(codes))
                    made, held, ids, lists = made + 1, 0, [], []
                    codes.clear()
        if ids:
            yield make_block(pair, first + made, ids, lists, list(codes))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each id pair linked, and whether no other pair of its A id has more."""
    asked = held.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = cut(asked.groupBy("pair").agg(F.sum("docs").alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row for each id of A at most, so it may be broadcast
    return counts.select("pair", "n", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block that has got the counts of its pairs."""
    names = [x.rsplit(" ", 1)[0] for x in _OUT.split(", ")]
    for batch in batches:
        for r in range(batch.num_rows):
            row = {f: batch.column(f)[r] for f in batch.schema.names}
            pairs, found = row["pairs"].values.to_numpy(), row["found"].values
            n, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            if found is not None and len(found):
                at = np.searchsorted(pairs, found.field("pair").to_numpy())
                n[at], best[at] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            bytes_of = lambda c: row[c].as_py()  # noqa: E731, B023
            n_links, links = _unpack(bytes_of("n_links"), np.int32), _unpack(bytes_of("links"), np.int32)
            chunk = np.repeat(np.arange(len(n_links)), n_links)
            once, times, n_chunks = _unpack(bytes_of("chunks"), np.int32), _unpack(bytes_of("times"), np.int32), _unpack(bytes_of("n_chunks"), np.int64)
            doc, sums = np.repeat(np.arange(len(n_chunks)), n_chunks), []
            for value in (best, n):
                of_chunk, of_doc = np.zeros(len(n_links), dtype=np.int64), np.zeros(len(n_chunks), dtype=np.int64)
                np.add.at(of_chunk, chunk, value[links])
                np.add.at(of_doc, doc, of_chunk[once] * times)
                sums.append(of_doc)
            stats = _unpack(bytes_of("stats"), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([row["doc_id"].values, *(pa.array(c) for c in (*stats.T, *sums)), row["shas"].values], names)


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text", size: int = 0) -> DataFrame:
    """For each document the numbers of tokens, groups and links, how many links are the best of their A id, and the sum of the links' counts."""
    held = cut(blocks(docs, a_path or default_paths()[0], b_path or default_paths()[1], key, text, size))
    asked = held.select("block", F.explode("pairs").alias("pair"))
    found = asked.join(pair_counts(held), "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("found"))
    return held.drop("docs").join(found, "block", "left").mapInArrow(_rows, _OUT)


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups): for each document the groups of A's and B's ids between shared cuts, in order."""
    a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]
    with open(b_path, "rb") as f:
        given = docs.sparkSession.sparkContext.broadcast((read_spec(a_path), f.read()))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*given.value)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                found = align_chunks(pair, chunks_of(" " + t)) if t else None
                signs = "".join(found.signs)[:-1] if found and found.good.all() else ""
                out.append([{"a": [int(i) for i in x.split(",")], "b": [int(i) for i in y.split(",")]} for x, y in (g.split("|") for g in signs.split(";"))] if signs else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=kind)], ["doc_id", "groups"])

    two = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
