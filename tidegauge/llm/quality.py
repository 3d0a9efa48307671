"""Quality classification by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from counts of its
characters' kinds, word lengths and repeated trigrams by one hidden layer; gated attention, learned from the
document labels alone, weighs the encodings, and a logistic unit scores the weighted mean. Every passage of
the whole text takes part.

The network is fitted on the driver on a bounded sample of ``FIT_ROWS`` labelled documents in the order of a
hash of the id, of which only the passages' ``FEATURES`` numbers are gathered. It has a few hundred weights.

Edge cases: null and empty texts are one passage of zeros and get a score like any other; with no labels
every score is 0.5; repeated rows are scored one by one; a document with several labels teaches each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, folds, query, slices, table

PASSAGE = 600
FIT_ROWS = 6000
HIDDEN, GATE = 16, 8

_KINDS = np.zeros(256, dtype=np.int64)
_KINDS[97:123] = 1  # lower case
_KINDS[65:91] = 2  # upper case
_KINDS[48:58] = 3  # digits
_KINDS[32] = 4
_KINDS[10] = 5
_KINDS[128:] = 6
for _k, _c in enumerate(".,!|", 7):
    _KINDS[ord(_c)] = _k
for _c in "#$%&*":
    _KINDS[ord(_c)] = 11
_N_KINDS = 12  # 0: the rest
FEATURES = _N_KINDS + 6


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts (n x FEATURES), and the number of passages of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([max(1, len(r)) for r in raw])
    b = np.frombuffer(b"".join(r or b"\0" for r in raw), dtype=np.uint8)
    counts = -(-sizes // PASSAGE)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bag = np.repeat(np.arange(len(raw)), counts)
    nth = np.arange(len(bag)) - np.repeat(np.cumsum(counts) - counts, counts)
    # equal parts: none is much shorter than the others
    starts = first[bag] + nth * sizes[bag] // counts[bag]
    ends = first[bag] + (nth + 1) * sizes[bag] // counts[bag]
    n = (ends - starts).astype(float)
    of = np.repeat(np.arange(len(bag)), ends - starts)
    kind = _KINDS[b]
    share = np.bincount(of * _N_KINDS + kind, minlength=len(bag) * _N_KINDS).reshape(-1, _N_KINDS)
    shares = share / n[:, None]
    blank = (kind == 4) | (kind == 5)
    begins = ~blank & np.concatenate(([True], blank[:-1] | (of[1:] != of[:-1])))
    words = np.bincount(of[begins], minlength=len(bag))
    # the distinct trigrams and words of a passage, by 16-bit hashes
    v = b.astype(np.uint32)
    tri = v.copy()
    tri[:-2] = (v[:-2] * np.uint32(0x9E3779B1)) ^ (v[1:-1] * np.uint32(0x85EBCA77)) ^ (v[2:] * np.uint32(0xC2B2AE3D))
    code = (of.astype(np.uint64) << np.uint64(16)) | (tri >> np.uint32(16)).astype(np.uint64)
    code.sort()
    fresh = np.concatenate(([True], code[1:] != code[:-1]))
    distinct = np.bincount((code[fresh] >> np.uint64(16)).astype(np.int64), minlength=len(bag))
    at = np.flatnonzero(begins)
    mixed = np.bitwise_xor.reduceat(tri, at) if len(at) else tri[:0]
    code = np.unique((of[at].astype(np.uint64) << np.uint64(32)) | mixed.astype(np.uint64))
    kinds_of_words = np.bincount((code >> np.uint64(32)).astype(np.int64), minlength=len(bag))
    letters = share[:, 1] + share[:, 2] + share[:, 6] + 1.0
    more = np.stack(
        [
            np.log1p(n) / 6,
            distinct / n,
            kinds_of_words / np.maximum(words, 1),
            n / np.maximum(words, 1) / 10,
            share[:, 2] / letters,
            (share[:, 0] + share[:, 7:12].sum(axis=1)) / letters,
        ],
        axis=1,
    )
    return np.hstack([shares, more]).astype(np.float32), counts


class Network:
    """Gated attention over encoded passages. ``parts`` are the weights by name."""

    def __init__(self, d: int = FEATURES, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.parts = {"W": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "o": np.zeros(1)}
        self.mean, self.scale = np.zeros(d), np.ones(d)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, first = self.parts, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["o"], -30, 30)))
        return {"x": x, "counts": counts, "first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradient(self, f: dict, labels: np.ndarray) -> dict:
        p = self.parts
        dy = (f["y"] - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], f["counts"], axis=0)
        da = (dz * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, f["first"]), f["counts"])
        de = f["a"] * (da - mean)
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "o": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Network:
        """Adam on all rows."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        m, v = ({k: np.zeros_like(p) for k, p in self.parts.items()} for _ in range(2))
        for s in range(1, steps + 1):
            grad = self.gradient(self.forward(x, counts), labels)
            for k, p in self.parts.items():
                g = grad[k] + decay * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, counts = passages(texts)
        return self.forward((x - self.mean) / self.scale, counts)["y"]


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, rows: int = FIT_ROWS, label: str = "quality", key: str = "doc_id", text: str = "text") -> Network | None:
    """Fit on at most ``rows`` labelled documents; ``train`` is a condition on the labels' key."""
    chosen = labels.filter(train & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(8)), "id", "label").limit(rows)
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in it:
            for part in chunks(list(whole["text"])):
                b = whole.iloc[part]
                x, n = passages(list(b["text"]))
                ends = np.cumsum(n)
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "x": [x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]})

    got = texts.join(F.broadcast(chosen), "id").mapInPandas(batches, "id long, label int, x binary").orderBy(F.xxhash64("id"), "id", "label").limit(2 * rows).collect()
    if not got:
        return None
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in got]
    return Network().fit(np.vstack(x).astype(float), np.array(list(map(len, x))), np.array([float(r["label"]) for r in got]))


def score(docs: DataFrame, model: Network | None, extra: list[F.Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the extra columns (booleans), score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    head = docs.select(F.col(key).cast("long").alias("doc_id"), *extra, F.col(text).cast("string").alias("text"))
    names = head.columns[:-1]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in it:
            for b in slices(whole, len(names)):
                s = m.score(b.column(len(names)).to_pylist()) if m else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return head.mapInArrow(batches, ", ".join(["doc_id long", *(f"{n} boolean" for n in names[1:]), "score double", "predicted int"]))


def keep_good(docs: DataFrame, model: Network | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = sent.value
        if m is None:
            return pd.Series(np.full(len(texts), 0.5))
        own = list(texts)
        return pd.Series(np.concatenate([m.score(own[c]) for c in chunks(own)] or [np.zeros(0)]))

    return docs.filter(scored(F.col(text).cast("string")) >= threshold)


@query("op8_quality")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~folds(3, 1))
    return score(docs, model, [folds(3, 1).alias("held_out")])
