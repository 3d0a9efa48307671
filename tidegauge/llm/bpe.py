"""BPE encoding and decoding of whole texts with a public word-level vocabulary.

A word is a doubly linked list of symbols. Every adjacent pair that the merge table knows waits in a
priority queue by its rank and position; the lowest is merged, its neighbours get new pairs, and entries
whose symbols have changed meanwhile are stale and skipped. A word of n symbols takes O(n log n), so one
unbroken run of 100,000 letters is no special case. Decoding looks every id up and concatenates the
vocabulary strings, with the separator that the tokenizer file implies (a space where it names no decoder).

Characters that Unicode 3.2 lacks may have other properties in Python's tables than in the tokenizer library's (letter
or not, lower case, order of marks); a part of a text that holds one is normalised and cut into words by the library
itself, and its words are merged here like all others. Everything else is done here.

Words repeat, so each worker keeps the results of the words it has seen in two generations of a bounded
cache; nothing depends on what is cached. The tokenizer file is read once on the driver from a path that
is a parameter (about 2 MB, broadcast).

Edge cases: null and empty texts give no ids and the empty string; ids and text survive repeated rows,
very long texts and words; an empty table gives no rows; other columns are ignored. A tokenizer file with parts that
aren't known here is refused with an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import query, slices, table

#: Words that one generation of a worker's cache holds; longer words than CACHED_LENGTH aren't kept.
CACHED_WORDS = 100_000
CACHED_LENGTH = 64
# What a tokenizer file must say for its texts to be normalised and cut here.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def _unsure() -> re.Pattern:
    """A character that Unicode 3.2 doesn't assign."""
    assigned = unicodedata.ucd_3_2_0.category
    ranges, first = [], None
    for c in range(0x110001):
        out = c < 0x110000 and assigned(chr(c)) == "Cn"
        if out and first is None:
            first = c
        elif not out and first is not None:
            ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return re.compile("[" + "".join(ranges) + "]")


class Bpe:
    """The parts of a tokenizer file that encoding and decoding need; other parts than these are refused."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model = t["model"]
        others = ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in others) or t.get("decoder") is not None:
            raise ValueError("only byte-level BPE with word ends and without a decoder is supported")
        steps = (t.get("normalizer") or {}).get("normalizers")
        cuts = (t.get("pre_tokenizer") or {}).get("pretokenizers")
        if steps != NORMALIZER or not cuts or len(cuts) != 2 or cuts[0].get("type") != "Split" or (cuts[0].get("behavior"), cuts[0].get("invert")) != ("Removed", True) or cuts[1] != BYTES:
            raise ValueError("the normalizer or pre-tokenizer of this file isn't supported")
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in t["added_tokens"]):
            raise ValueError("added tokens must match literally")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.width = max(self.vocab.values()) + 1
        self.merges: dict[int, tuple[int, int]] = {}  # left id * width + right id: rank, merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] * self.width + self.vocab[b], (rank, self.vocab[a + b]))
        special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.special = special
        self.strings = {i: s for s, i in {**self.vocab, **special}.items()}
        self.joint = " "
        parts = sorted(special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, parts)) + ")") if parts else None
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"], regex.V0)
        #: Whether runs of letters, and points and commas among letters, are words by themselves.
        self.plain = cuts[0]["pattern"]["Regex"] == PATTERN
        letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = [self.vocab.get(x) for x in letters], [self.vocab.get(x + self.end) for x in letters]
        self.complete = None not in self.inner and None not in self.last
        # normalizer and pre-tokenizer are all that the library is asked for, so it gets no vocabulary
        self.spec, self._library = json.dumps({**t, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}), None

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the queue of merge ranks."""
        raw = word.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if not self.complete:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        merges, width = self.merges, self.width
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        # an entry is rank * n + position; it is stale when the pair at the position has another rank by now
        queue = [m[0] * n + i for i, a in enumerate(ids[:-1]) if (m := merges.get(a * width + ids[i + 1]))]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = right[i]
            if ids[i] < 0 or j < 0 or (m := merges.get(ids[i] * width + ids[j])) is None or m[0] != rank:
                continue
            new = m[1]
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get(new * width + ids[k]):
                    heappush(queue, m[0] * n + i)
            h = left[i]
            if h >= 0 and (m := merges.get(ids[h] * width + new)):
                heappush(queue, m[0] * n + h)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[str | int | list[str]]:
        """Ids of special tokens that stand in the text, and between them the normalised text, or its words where the library has to cut them."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                if part.isascii():
                    yield part.lower()
                elif _unsure().search(part):
                    yield self.library_words(part)
                else:
                    part = unicodedata.normalize("NFC", part)
                    # character by character: no final sigma
                    yield part.lower() if "Σ" not in part else part.replace("Σ", "σ").lower()

    def library_words(self, part: str) -> list[str]:
        """Words of a part as the tokenizer library normalises and cuts it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        t = self._library
        return [bytes(map(self.bytes.__getitem__, w)).decode("utf-8") for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        for part in self.pieces(text or ""):
            if isinstance(part, int):
                out.append(part)
            else:
                for word in self.pattern.findall(part) if isinstance(part, str) else part:
                    out += self.merge(word)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids; ids that the vocabulary lacks are left out."""
        return self.joint.join(s for i in ids if (s := self.strings.get(i)) is not None)


class Cached:
    """Encoding of runs without white space, kept in two generations: what is used again moves to the young one."""

    def __init__(self, bpe: Bpe, most: int = CACHED_WORDS):
        self.bpe, self.most = bpe, most
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def run(self, run: str, whole: bool = False) -> tuple[int, str, str]:
        """Number of ids, the ids joined by spaces, and their decoded text; ``whole``: the run is one word."""
        got = self.young.get(run) or self.old.get(run)
        if got is None:
            ids: list[int] = []
            for word in [run] if whole or run.isalpha() else self.bpe.pattern.findall(run):
                ids += self.bpe.merge(word)
            got = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
        if len(run) <= CACHED_LENGTH:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[run] = got
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        n, ids, words = 0, [], []
        run = self.run
        for part in self.bpe.pieces(text or ""):
            if isinstance(part, int):
                found = [(1, str(part), self.bpe.strings[part])]
            elif isinstance(part, list):
                found = [run(x, True) for x in part]
            elif not self.bpe.plain:
                found = [run(x, True) for x in self.bpe.pattern.findall(part)]
            else:
                if not _MARKS.search(part):  # points and commas by themselves: the words before them are then found in the cache
                    part = part.replace(".", " . ").replace(",", " , ")
                # str.split() also splits at the four control characters FS, GS, RS and US, which are no white space to the pattern
                runs = part.split() if not _CONTROLS.search(part) else _SPACE.split(part)
                young = self.young.get
                found = [young(x) or run(x) for x in runs if x]
            n += sum([x[0] for x in found])
            ids += [x[1] for x in found if x[0]]
            words += [x[2] for x in found if x[0]]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return n, sha(" ".join(ids)), sha(self.bpe.joint.join(words))


_CONTROLS = regex.compile("[\x1c-\x1f]")
_MARKS = regex.compile(r"[.,][^\s\p{L}\p{N}]|[^\s\p{L}\p{N}][.,]")
_SPACE = regex.compile(r"\s+")
_LOADED: dict[str, Cached] = {}


def _cached(spec: str, most: int) -> Cached:
    """One cache for each tokenizer in a worker process."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Cached(Bpe(spec))
    _LOADED[key].most = most
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _map(spark: SparkSession, docs: DataFrame, path: str | None, schema: str, row, cached_words: int = CACHED_WORDS) -> DataFrame:
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _cached(spec.value, cached_words)
        for b in it:
            yield from row(cached, b)

    return docs.mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document."""

    def rows(cached: Cached, b: pa.RecordBatch):
        ids = [[int(i) for i in cached.bpe.encode(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _map(docs.sparkSession, docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), path, "doc_id long, ids array<int>", rows)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def rows(cached: Cached, b: pa.RecordBatch):
        texts = [cached.bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _map(encoded.sparkSession, encoded.select("doc_id", "ids"), path, "doc_id long, text string", rows)


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, in one pass over the texts.

    ``cached_words`` trades memory (about 0.4 KB a word and worker, twice) for time.
    """

    def rows(cached: Cached, b: pa.RecordBatch):
        for part in slices(b, 1):
            found = [cached.digest(t) for t in part.column(1).to_pylist()]
            n, ids, decoded = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    two = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _map(docs.sparkSession, two, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, cached_words)


@query("op1_bpe")
def op1(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), cached_words=250_000)
