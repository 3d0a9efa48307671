"""Toxicity by weak supervision.

Voters look at the words of a text. There is one lexicon voter for each listed word (a short list of
insults in four languages, and the words and stems mined from the labelled rows of the training folds by log-odds of
their document frequencies), and pattern voters for repeated hits, distinct hits, a high share of hits, and
a hit next to a second-person word.

A generative label model, fitted by EM over labelled and unlabelled rows of the training folds, explains the votes
by a hidden class. Within each class the voters form a forest: every voter depends on at most one other, its parent,
and the forest is the one of largest conditional mutual information given the class (Chow and Liu's tree, without the
links that chance explains). So the model holds an accuracy for every voter and the correlations between voters, and
ten voters that always fire together count as one. Hand labels are no votes: they give the counts that the parameters
start from and are drawn to (each labelled row adds its votes once to its class), which fixes which class is which,
and they check the result (``agreement``). The posterior of a row comes from its votes alone, whether or not somebody
labelled it. A logistic model over the same votes, the number and the share of hits is trained on these posteriors and
scores every whole text.

Word frequencies and votes are gathered over bounded samples in the order of a hash of the id: ``FIT_ROWS`` labelled
rows and as many unlabelled ones; at most ``LEXICON`` words and ``STEMS`` stems, the best of all that are frequent and
telling enough, are voters. The fit sees a matrix of at most 2 FIT_ROWS x voters.

Edge cases: null and empty texts have no words and get the score of a text without hits; with no labels
the listed words alone vote; repeated rows are scored one by one; a document with several labels teaches
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, folds, query, slices, table

FIT_ROWS = 12_000
LEXICON = 120
#: Stems are the first letters of longer words: they find inflected and compounded insults that are rare as whole words.
STEM, STEMS = 6, 40
LEAST_SUPPORT = 4
LEAST_ODDS = 6.0
# A short list of common insults.
LISTED = "idiot stupid moron loser scum trash worthless pathetic disgusting clown dumb imbecile bastard arschloch dummkopf trottel depp abschaum imbécile crétin connard salaud ordure idiota estúpido imbécil basura escoria".split()
SECOND_PERSON = frozenset("you your du dein euch tu vous ton votre tú usted vosotros".split())
WORD = re.compile(r"\w+")
PATTERNS = 6
NUMBERS = 4


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def votes(text: str | None, lexicon: dict[str, int]) -> tuple[list[int], np.ndarray]:
    """The lexicon voters that fire, and the pattern voters' votes, numbers and shares of hits. Stems are entries that end in ``*``."""
    ws = words(text)
    hits = [(i, w) for i, w in enumerate(ws) if w in lexicon]
    stems = [s for w in ws if len(w) > STEM and (s := w[:STEM] + "*") in lexicon]
    kinds = {w for _, w in hits}
    n, m, total = len(hits), len(stems), max(1, len(ws))
    near = any(x in SECOND_PERSON for i, _ in hits for x in ws[max(0, i - 3) : i + 4])
    fired = sorted(lexicon[w] for w in kinds | set(stems))
    return fired, np.array([n >= 2, len(kinds) >= 2, n / total >= 0.005, near, m >= 2, m / total >= 0.01, np.log1p(n), min(1.0, 20 * n / total), np.log1p(m), min(1.0, 20 * m / total)])


def matrix(texts: list[str | None], lexicon: dict[str, int]) -> np.ndarray:
    """Lexicon votes, pattern votes, numbers and shares of hits, a row for each text."""
    x = np.zeros((len(texts), len(lexicon) + PATTERNS + NUMBERS))
    for r, t in enumerate(texts):
        fired, rest = votes(t, lexicon)
        x[r, fired] = 1
        x[r, len(lexicon) :] = rest
    return x


class LabelModel:
    """A two-class mixture of voters that form a forest within the classes, fitted by EM.

    ``fired`` is rows x voters (0 or 1), ``hand`` holds 0, 1, or nan where a row has no label. After the fit, ``parent``
    is each voter's parent (-1 for roots), ``table[y, j, p]`` the probability that voter j fires in class y when its
    parent's vote is p, ``rate[y, j]`` without regard to the parent, and ``accuracy[j]`` how often voter j is right.
    """

    def __init__(self, fired: np.ndarray, hand: np.ndarray, rounds: int = 20):
        fired = fired.astype(np.float32)
        known = ~np.isnan(hand)
        yes = np.where(known, np.nan_to_num(hand) > 0.5, 0.0).astype(np.float32)
        anchor = np.stack([known - yes, yes])  # what the labelled rows add to either class
        if known.any():
            weights = anchor.astype(np.float32)
        else:
            toxic = np.where(fired.any(axis=1), 0.9, 0.1)
            weights = np.stack([1 - toxic, toxic]).astype(np.float32)
        for step in range(rounds):
            self._estimate(fired, weights, structure=step in (0, 3, 9))
            self.posterior = self.predict(fired)
            before, weights = weights, np.stack([1 - self.posterior, self.posterior]).astype(np.float32) + anchor
            if step > 10 and np.abs(weights - before).max() < 1e-4:
                break
        self.agreement = float(((self.posterior > 0.5) == (yes > 0.5))[known].mean()) if known.any() else float("nan")

    def _estimate(self, fired: np.ndarray, weights: np.ndarray, structure: bool) -> None:
        """Rates, tables and (now and then) the forest from the rows' weights in either class."""
        n, k = weights.sum(axis=1), fired.shape[1]
        both = np.stack([(fired * w[:, None]).T @ fired for w in weights])  # [y, j, p]: j and p fire
        alone = np.stack([np.diag(b) for b in both])
        self.prior = float(np.clip((n[1] + 0.5) / (n.sum() + 1), 1e-3, 1 - 1e-3))
        self.rate = np.clip((alone + 0.05) / (n[:, None] + 1), 1e-5, 1 - 1e-5)
        if structure:
            self.parent = self._forest(both, alone, n)
        self.table = np.stack([self.rate, self.rate], axis=2)
        for j, p in enumerate(self.parent):
            if p >= 0:
                for y in (0, 1):
                    hits = np.array([alone[y, j] - both[y, j, p], both[y, j, p]])
                    of = np.array([n[y] - alone[y, p], alone[y, p]])
                    self.table[y, j] = np.clip((hits + 0.2 * self.rate[y, j]) / (of + 0.2), 1e-5, 1 - 1e-5)
        share = np.array([1 - self.prior, self.prior])
        self.accuracy = share[1] * self.rate[1] + share[0] * (1 - self.rate[0]) if k else np.zeros(0)

    @staticmethod
    def _forest(both: np.ndarray, alone: np.ndarray, n: np.ndarray, least: float = 13.8) -> np.ndarray:
        """Parents of the maximum spanning forest by conditional mutual information; links of a likelihood ratio under ``least`` (chance: 0.001) are left out."""
        k = both.shape[1]
        gain = np.zeros((k, k))
        for y in (0, 1):
            on = alone[y]
            cells = ((both[y], on[:, None], on[None, :]), (on[:, None] - both[y], on[:, None], n[y] - on[None, :]), (on[None, :] - both[y], n[y] - on[:, None], on[None, :]), (n[y] - on[:, None] - on[None, :] + both[y], n[y] - on[:, None], n[y] - on[None, :]))
            for joint, a, b in cells:
                with np.errstate(divide="ignore", invalid="ignore"):
                    term = joint * np.log(joint * max(n[y], 1e-9) / (a * b))
                gain += np.where((joint > 1e-6) & np.isfinite(term), term, 0.0)
        np.fill_diagonal(gain, 0)
        parent, best, via, inside = np.full(k, -1), np.zeros(k), np.full(k, -1), np.zeros(k, dtype=bool)
        for _ in range(k):
            j = int(np.where(inside, -1.0, best).argmax())
            inside[j] = True
            parent[j] = via[j]
            better = ~inside & (2 * gain[j] >= least) & (gain[j] > best)
            best[better], via[better] = gain[j][better], j
        return parent

    def predict(self, fired: np.ndarray) -> np.ndarray:
        """The posterior of the toxic class from the votes alone."""
        rooted = self.parent < 0
        on, off = np.log(self.table[1] / self.table[0]), np.log((1 - self.table[1]) / (1 - self.table[0]))  # [j, p]
        up = np.where(rooted, 0, self.parent)
        single, pair = on[:, 0] - off[:, 0], np.where(rooted, 0.0, on[:, 1] - off[:, 1] - on[:, 0] + off[:, 0])
        np.add.at(single, up[~rooted], (off[:, 1] - off[:, 0])[~rooted])  # what a parent's vote adds where its child doesn't fire
        odds = np.log(self.prior / (1 - self.prior)) + off[:, 0].sum() + fired @ single + (fired * fired[:, up]) @ pair
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights, the last for the bias, by Newton steps on soft targets."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


class Model:
    def __init__(self, lexicon: list[str], weights: np.ndarray, voters: LabelModel | None = None):
        self.lexicon, self.weights, self.voters = {w: i for i, w in enumerate(lexicon)}, weights, voters

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = matrix(texts, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, rows: int = FIT_ROWS, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Mine the lexicon, fit the label model and train the classifier; ``train`` is a condition on the key, which documents and labels share."""
    ids = labels.filter(train & F.col(key).isNotNull())
    chosen = ids.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(2)), "id", "label").limit(rows)
    others = docs.filter(train & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).join(ids.select(F.col(key).alias("id")), "id", "left_anti")
    others = others.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(rows).distinct().withColumn("label", F.lit(None).cast("int"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        size = Counter()
        for b in it:
            for t, y in zip(b["text"], b["label"], strict=True):
                own = set(words(t))
                seen[int(y > 0)].update(own | {w[:STEM] + "*" for w in own if len(w) > STEM})
                size[int(y > 0)] += 1
        for y, c in seen.items():
            # the empty word counts the documents
            yield pd.DataFrame({"word": ["", *c], "t": [y * n for n in (size[y], *c.values())], "c": [(1 - y) * n for n in (size[y], *c.values())]})

    freq = sample.mapInPandas(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    freq = freq.filter((F.col("word") == "") | (F.col("t") >= LEAST_SUPPORT))
    freq = cut(freq)
    size = freq.filter("word = ''").first()
    toxic, clean = (size["t"], size["c"]) if size else (0, 0)
    rank = -F.col("t") * F.log(_odds(toxic, clean))
    telling = freq.filter((F.col("word") != "") & (_odds(toxic, clean) >= LEAST_ODDS))
    stem = F.col("word").endswith("*")
    best = lambda which, most: [r["word"] for r in telling.filter(which).orderBy(rank, "word").limit(most).collect()]
    lexicon = list(dict.fromkeys([*LISTED, *best(~stem, LEXICON), *best(stem, STEMS)]))
    index = {w: i for i, w in enumerate(lexicon)}

    def vote(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            x = matrix(list(b["text"]), index).astype(np.float32)
            yield pd.DataFrame({"id": b["id"], "label": b["label"].astype("Int32"), "x": [r.tobytes() for r in x]})

    voted = sample.unionByName(texts.join(F.broadcast(others), "id")).mapInPandas(vote, "id long, label int, x binary")
    rows_ = voted.orderBy(F.xxhash64("id"), "id", "label").limit(4 * rows).collect()
    width = len(lexicon) + PATTERNS + NUMBERS
    if not any(r["label"] is not None for r in rows_):  # nothing to learn from: any listed word, more with each
        w = np.zeros(width + 1)
        w[: len(lexicon)], w[-1] = 3.0, -2.0
        return Model(lexicon, w)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows_])
    hand = np.array([np.nan if r["label"] is None else float(r["label"] > 0) for r in rows_])
    voters = LabelModel(x[:, : len(lexicon) + PATTERNS], hand)
    return Model(lexicon, logistic(x.astype(float), voters.posterior), voters)


def _odds(toxic: int, clean: int) -> F.Column:
    """How much likelier a word (t, c) is in a toxic document, smoothed."""
    return ((F.col("t") + 0.1) / (toxic + 1)) / ((F.col("c") + 0.1) / (clean + 1))


def score(docs: DataFrame, model: Model, extra: list[F.Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the extra columns (booleans), score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(Model(list(model.lexicon), model.weights))  # the label model stays here
    head = docs.select(F.col(key).cast("long").alias("doc_id"), *extra, F.col(text).cast("string").alias("text"))
    names = head.columns[:-1]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in it:
            for b in slices(whole, len(names)):
                s = m.score(b.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return head.mapInArrow(batches, ", ".join(["doc_id long", *(f"{n} boolean" for n in names[1:]), "score double", "predicted int"]))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), ~folds(5, 0)), [folds(5, 0).alias("held_out")])
