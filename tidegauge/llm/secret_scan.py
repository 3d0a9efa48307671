"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over the characters of identifiers are trained from labelled samples: one on random
strings, one on ordinary identifiers and words. The labels come from the documents themselves (:func:`observe`): what
the fixed patterns mark as a secret is random, the other runs of eight or more characters are ordinary. To these are
added, with equal weight, random strings over the usual alphabets and identifiers composed of common parts
(:func:`samples`), for kinds of secrets that the sample lacks.

The text outside the fixed patterns' spans is cut into runs of identifier characters of ``LEAST`` or more, and the
stretches of a run that the random model explains best are found in one pass: every character adds its log-likelihood
ratio less ``MARGIN``; a stretch starts where the sum leaves zero, ends at its highest value, and is closed when the
sum has fallen by ``DROP`` below that. So a secret behind a long ordinary path is still found, and the rest of a run
beside a fixed span is scanned too. A stretch of ``KERNEL`` characters or more whose sum reaches ``EVIDENCE`` (more where
it holds no digit) is a span of kind ``model``. The spans that the fixed patterns find always stay, and no model span touches them.

The models are fitted on at most ``FIT_DOCS`` documents in the order of a hash of the id (counts only come back: 2 x 66
x 65 numbers), and as many numbers are sent to the workers.

Offsets are code points, ends exclusive. Edge cases: null texts count as empty; whole texts of any length
are scanned, in time that grows with the text; repeated rows are scanned one by one; with no documents to learn from
the composed samples alone are the training set; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import query, slices, table

KINDS = ("assign", "access", "hex", "model")


def _either(word: str) -> str:
    """The ASCII letters in either case; nothing else folds."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The patterns and least lengths of the contract.
ASSIGN = re.compile("(?:" + "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")  # a shorter run fails and holds no other match
LEAST = 16
RUN = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ORDINARY = re.compile("[A-Za-z0-9+/_=-]{8,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Of a stretch: characters at least; sum at least, and where it holds no digit.
KERNEL, EVIDENCE, LETTERS_EVIDENCE = 12, 8.0, 16.0
MARGIN, DROP = 0.3, 12.0
FIT_DOCS = 20_000
_AT = {c: i for i, c in enumerate(ALPHABET)}


def samples(seed: int = 7, n: int = 4000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings, ordinary identifiers."""
    r = random.Random(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:65], "0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[26:62]]
    secrets = ["".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(16, 48))) for i in range(n)]
    parts = "get set user name file path index count value list map data type node tree item page url host key hash load save read write open close start stop init config test main util base view model table row column query select insert update delete the and with from for this that there nation tion ment ing ed er ly able ness ende keit ung schaft heit ation eaux ment elle ier cion ando mente aje idad http www com org net html index img css static content article category post search 2019 2020 2021 2024 v1 v2 01 10 100".split()
    plain = []
    for i in range(n):
        chosen = r.choices(parts, k=r.randint(2, 7))
        style = i % 7
        if style == 0:
            plain.append("_".join(chosen))
        elif style == 1:
            plain.append("".join(x.capitalize() for x in chosen))
        elif style == 2:
            plain.append("/".join(chosen))
        elif style == 3:
            plain.append("".join(chosen))
        elif style == 4:
            plain.append("_".join(chosen).upper())
        elif style == 5:
            plain.append("-".join(chosen).upper() if i % 2 else "-".join(chosen))
        else:
            plain.append(r.choice(ALPHABET) * r.randint(4, 40) if i % 2 else "=" * r.randint(3, 40) + "-" * r.randint(0, 40))
    return secrets, plain


def transitions(texts: Iterable[str]) -> np.ndarray:
    """How often each character follows each other one; the last row is for the first character."""
    n = np.zeros((len(ALPHABET) + 1, len(ALPHABET)))
    for t in texts:
        at = [_AT[c] for c in t if c in _AT]
        np.add.at(n, ([len(ALPHABET), *at[:-1]] if at else [], at), 1)
    return n


def train(secrets: np.ndarray, ordinary: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of every transition from the counts of both kinds of samples."""
    model = lambda n: np.log((n + smoothing) / (n + smoothing).sum(axis=1, keepdims=True))
    return model(secrets) - model(ordinary)


def observe(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Transition counts (random, ordinary) of the documents' own strings, labelled by the fixed patterns."""
    ids = docs.select(F.col(key).alias("id")).filter("id is not null").orderBy(F.xxhash64("id", F.lit(4)), "id").limit(rows).distinct()
    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id").select("text")
    width = len(ALPHABET)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width + 1, width))
        for b in it:
            for t in b.column(0).to_pylist():
                spans = base_spans(t or "")
                # of an assignment the value only; repeated digits of a span within a span count once
                total[0] += transitions(re.sub(r"^.*[:= \"']", "", t[s:e]) for s, e in _merged(spans))
                total[1] += transitions(m.group() for m in _outside(t or "", spans, ORDINARY))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    out = np.zeros(2 * (width + 1) * width)
    for r in chosen.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    random_, ordinary = out.reshape(2, width + 1, width)
    return random_, ordinary


def fit(docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The table of log-likelihood ratios from the documents' strings and the composed samples, each half of the weight."""
    seen = observe(docs, key, text) if docs is not None else (np.zeros((len(ALPHABET) + 1, len(ALPHABET))),) * 2
    out = []
    for own, composed in zip(seen, map(transitions, samples()), strict=True):
        out.append(composed + own * (composed.sum() / own.sum() if own.sum() else 0.0))
    return train(*out)


def ratios(table_: np.ndarray, run: str) -> np.ndarray:
    """The log-likelihood ratio of each character of a run over the alphabet."""
    at = [_AT[c] for c in run]
    return table_[[len(ALPHABET), *at[:-1]], at]


def stretches(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, sum) of the stretches with the highest sums of ``score`` less the margin, in one pass."""
    out: list[tuple[int, int, float]] = []
    total = top = 0.0
    start = end = 0

    def close() -> None:
        if end - start >= KERNEL and top >= EVIDENCE:
            out.append((start, end, top))

    for k, v in enumerate((score - MARGIN).tolist()):
        total += v
        if total > top:
            top, end = total, k + 1
        if total <= 0 or total < top - DROP:
            close()
            total, top, start, end = 0.0, 0.0, k + 1, k + 1
    close()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, in order, overlaps joined."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _outside(text: str, spans: list[tuple[int, int, int]], pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches in the text between the spans."""
    at = 0
    for s, e in [*_merged(spans), (len(text), len(text))]:
        yield from pattern.finditer(text, at, s)
        at = e


def model_spans(text: str, table_: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches that the random model explains better and that touch no base span; one that is most of its run stands for all of it."""
    out = []
    for m in _outside(text, base, RUN):
        run = m.group()
        for s, e, total in stretches(ratios(table_, run)):
            if total >= LETTERS_EVIDENCE or any(c.isdigit() for c in run[s:e]):
                out.append((m.start(), 3, m.end()) if 4 * (e - s) >= 3 * len(run) else (m.start() + s, 3, m.start() + e))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, model: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model of every document."""
    model = fit() if model is None else model

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, 1):
                rows = []
                for t in b.column(1).to_pylist():
                    base = base_spans(t or "")
                    more = model_spans(t or "", model, base)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more), len(more)))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    two = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return two.mapInArrow(batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


@query("op3_secret_scan")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
