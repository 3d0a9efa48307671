"""Language identification by hierarchical discrimination.

A text is a vector of hashed byte trigrams of its lower-cased letters (square roots of relative
frequencies, whole text). Machines for each language family, one against the rest, choose the family;
within it a linear support vector machine for every pair of its languages votes, ties going to the larger
sum of margins. Languages that the family table lacks form families of their own.

The machines are fitted on the driver on a bounded sample: at most ``FIT_ROWS`` labelled rows, dealt evenly
over the languages by a hash of the id; the fractions come from counts over all labelled rows. Their
vectors, ``DIMENSIONS`` floats a row, are made on the executors.

Edge cases: texts that are null or hold no letter are ``und`` with score 0, as are all texts when there is
nothing to learn from; rows without a language teach nothing; with one language every text with a letter
gets it; repeated rows are predicted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import svm
from tidegauge.llm.common import folds, query, slices, table

DIMENSIONS = 2048
FIT_ROWS = 4000
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# Bytes that aren't ASCII letters or parts of other characters count as blanks.
_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[97:123], _LETTERS[128:] = np.arange(97, 123), np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte trigrams, blanks folded."""
    b = _LETTERS[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(b) < 3:
        return np.zeros(DIMENSIONS, dtype=np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    n = np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=DIMENSIONS)
    return np.sqrt(n / n.sum()).astype(np.float32)


class Model:
    """The machines; :meth:`predict` takes a matrix of vectors."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_ = np.array(langs, dtype=object)
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(_FAMILY.get(lang, f"other:{lang}"), []).append(lang)
        self.families = sorted(self.members)
        of = np.array([_FAMILY.get(x, f"other:{x}") for x in langs], dtype=object)
        self.first = {f: svm.train(x, of == f) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for family in self.families:
            for a, b in combinations(self.members[family], 2):
                two = (langs_ == a) | (langs_ == b)
                self.pairs[a, b] = svm.train(x[two], langs_[two] == a)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        scores = np.stack([svm.margins(x, self.first[f]) for f in self.families], axis=1) if self.first else np.ones((n, 1))
        family = scores.argmax(axis=1)
        lang, score = [""] * n, np.ones(n)
        if self.first:
            score *= sure(scores[np.arange(n), family])
        for k, f in enumerate(self.families):
            at = np.flatnonzero(family == k)
            if not len(at):
                continue
            own = self.members[f]
            votes, total = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for i, j in combinations(range(len(own)), 2):
                m = svm.margins(x[at], self.pairs[own[i], own[j]])
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += m
                total[:, j] -= m
            best = (votes + 1e-3 * np.tanh(total)).argmax(axis=1)
            for r, b in zip(at, best, strict=True):
                lang[r] = own[b]
            if len(own) > 1:
                score[at] *= sure(total[np.arange(len(at)), best] / (len(own) - 1))
        return lang, score


def fit(docs: DataFrame, train: F.Column, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on at most about ``rows`` of the rows where ``train`` holds and the language is known."""
    known = docs.filter(train & F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(rows // 2 + 1).collect()}
    if not counts:
        return None
    if len(counts) > rows // 2:
        raise ValueError(f"more than {rows // 2} languages: there is a pair of rows for each at least, so raise rows")
    each = max(2, rows // len(counts))
    fraction = F.lit(0.0)
    for code, n in counts.items():
        fraction = F.when(F.col("lang") == code, min(1.0, each / n)).otherwise(fraction)
    chosen = known.filter((F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) / 1e6) < fraction)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "v": [vector(t).tobytes() for t in b["text"]]})

    got = chosen.mapInPandas(batches, "id long, lang string, v binary").orderBy(F.xxhash64("id"), "id", "lang").limit(2 * rows).collect()
    if not got:
        return None
    return Model(np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in got]), [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None, held_out: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in it:
            for b in slices(whole, 2):
                texts = b.column(2).to_pylist()
                lang, score = m.predict(np.stack([vector(t) for t in texts])) if m else (["und"] * len(texts), np.zeros(len(texts)))
                for i, t in enumerate(texts):
                    if not has_letter(t):
                        lang[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    three = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return three.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op9_language_id")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = folds(3, 1)
    return identify(docs, fit(docs, ~out), out)
