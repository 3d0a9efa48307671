import os

import numpy as np
import pytest
from helpers import ODD, docs
from pyspark.sql import functions as F

from tidegauge.llm import language_id, quality, queries, toxicity
from tidegauge.llm.common import folds, table

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def accuracy(df, want, got):
    r = df.filter("held_out").agg(F.count("*").alias("n"), F.count_if(F.col(want) == F.col(got)).alias("ok")).first()
    return r.ok / r.n


@tables
def test_held_out_language(spark):
    out = queries.QUERIES["op9_language_id"](spark, SF)
    d = table(spark, SF, "documents")
    assert out.count() == d.count()
    assert accuracy(out.join(d.select("doc_id", "lang"), "doc_id"), "lang", "lang_pred") > 0.98


@tables
@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.92)])
def test_held_out_labels(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF)
    bounds = out.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1 and bounds[2] == table(spark, SF, "documents").count()
    assert out.filter((F.col("score") >= 0.5) != (F.col("predicted") == 1)).isEmpty()
    assert accuracy(out.join(table(spark, SF, "labels"), "doc_id"), label, "predicted") >= least


def test_gradient():
    """The network's gradient against differences."""
    rng = np.random.default_rng(1)
    x, counts, y = rng.normal(size=(12, quality.FEATURES)), np.array([3, 1, 5, 3]), np.array([1.0, 0, 1, 0])
    net = quality.Network()
    loss = lambda: float(-np.mean(y * np.log(net.forward(x, counts)["y"]) + (1 - y) * np.log(1 - net.forward(x, counts)["y"])))
    grad = net.gradient(net.forward(x, counts), y)
    for k, p in net.parts.items():
        flat, g = p.reshape(-1), grad[k].reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_passages_cover_whole_texts():
    text = "ab " * 1000
    x, n = quality.passages([text, None, "", "x" * quality.PASSAGE])
    assert list(n) == [5, 1, 1, 1] and len(x) == 8 and np.isfinite(x).all()


def voters(n=4000, seed=2, copies=9, labelled=0.2):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    noisy = lambda p: np.where(rng.random(n) < p, y, ~y)
    good, other, third = noisy(0.9), noisy(0.8), noisy(0.8)
    votes = np.stack([good, other, third, *[good] * copies], axis=1).astype(float)
    return y, votes, np.where(rng.random(n) < labelled, y, np.nan)


def test_label_model_counts_copies_once():
    """Accuracies are recovered, and nine copies of a voter change the posteriors little."""
    y, votes, hand = voters()
    m, plain = toxicity.LabelModel(votes, hand), toxicity.LabelModel(votes[:, :3], hand)
    assert abs(m.rate[1, 0] - 0.9) < 0.04 and abs(m.rate[0, 0] - 0.1) < 0.04
    assert abs(m.accuracy[0] - 0.9) < 0.03 and abs(m.accuracy[1] - 0.8) < 0.03
    assert (m.parent[3:] >= 0).sum() >= 8 and (plain.parent < 0).all()
    assert np.abs(m.posterior - plain.posterior).mean() < 0.03
    assert ((m.posterior > 0.5) == y).mean() > 0.88


def test_posterior_by_enumeration():
    """Each class's probabilities of all vote patterns sum to 1, and the posterior is Bayes' rule on them."""
    rng = np.random.default_rng(5)
    y, votes, hand = voters(copies=1, seed=3)
    votes[:, 3] = np.where(rng.random(len(y)) < 0.9, votes[:, 3], 1 - votes[:, 3])
    votes = np.hstack([votes, np.where(rng.random((len(y), 1)) < 0.7, votes[:, 3:4], votes[:, 1:2])])
    m = toxicity.LabelModel(votes, hand)
    assert (m.parent >= 0).sum() >= 2
    patterns = np.array([[i >> j & 1 for j in range(5)] for i in range(32)], dtype=float)
    chance = np.ones((2, 32))
    for c in (0, 1):
        for i, v in enumerate(patterns):
            for j, p in enumerate(m.parent):
                on = m.table[c, j, int(v[p]) if p >= 0 else 0]
                chance[c, i] *= on if v[j] else 1 - on
    assert np.allclose(chance.sum(axis=1), 1)
    bayes = m.prior * chance[1] / (m.prior * chance[1] + (1 - m.prior) * chance[0])
    assert np.allclose(m.predict(patterns), bayes, atol=1e-6)
    seen = [np.mean((votes[y] == v).all(axis=1)) for v in patterns]
    assert np.abs(chance[1] - seen).max() < 0.05


def test_hand_labels_are_no_votes():
    """Rows without a label get as good a posterior as rows with one, and wrong labels are outvoted."""
    y, votes, hand = voters(copies=0, labelled=0.3)
    wrong = ~np.isnan(hand) & (np.random.default_rng(1).random(len(y)) < 0.1)
    m = toxicity.LabelModel(votes, np.where(wrong, 1 - hand, hand))
    known = ~np.isnan(hand)
    right = (m.posterior > 0.5) == y
    assert abs(right[known].mean() - right[~known].mean()) < 0.04 and right[wrong].mean() > 0.85
    same = {}
    for v, p in zip(map(tuple, votes), m.posterior, strict=True):
        assert abs(same.setdefault(v, p) - p) < 1e-9
    assert np.isnan(toxicity.LabelModel(votes, np.full(len(y), np.nan)).agreement)


@tables
def test_posterior_of_unlabelled_rows(spark):
    """Labels hidden from the fit agree with the posteriors of their rows."""
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    hide = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    m = toxicity.fit(d, labels.filter(~hide), ~folds(5, 0))
    hidden = d.join(labels.filter(hide), "doc_id").filter(~folds(5, 0)).select("text", "toxic").collect()
    x = toxicity.matrix([r.text for r in hidden], m.lexicon)
    posterior = m.voters.predict(x[:, : len(m.lexicon) + toxicity.PATTERNS])
    assert np.mean((posterior > 0.5) == np.array([r.toxic == 1 for r in hidden])) > 0.93 and m.voters.agreement > 0.95


def test_edge_cases(spark):
    rows = [(i, t, "en") for i, t in ODD] + [(100, "12 34 !!", "en"), (101, "plain words here", None)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    everything = F.lit(True)
    lang = {(r.doc_id, r.lang_pred) for r in language_id.identify(df, language_id.fit(df, everything), folds(3, 1)).collect()}
    assert {(1, "und"), (2, "und"), (7, "und"), (100, "und"), (3, "en"), (6, "en"), (101, "en")} <= lang
    assert {r.lang_pred for r in language_id.identify(df, None, folds(3, 1)).collect()} == {"und"}
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        model = op.fit(df, labels, everything, label=label)
        out = op.score(df, model, [folds(5, 0).alias("held_out")]).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        none = op.fit(df, labels.limit(0), everything, label=label)
        assert op.score(df, none, []).count() == len(rows)
        assert op.score(df.limit(0), model, []).count() == 0
    assert toxicity.Model(*[["idiot"], np.array([3.0] + [0.0] * 10 + [-2.0])]).score(["you idiot", "", None])[0] > 0.5
    assert quality.keep_good(df, None).count() == len(rows)
