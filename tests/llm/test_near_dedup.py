import os
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, docs, near_groups, shingles

from tidegauge.llm import near_dedup as N

SF = "/root/testdata/sf0.01"


def texts(n=60, seed=1):
    """Originals, near copies of different strength, chains of copies, and documents that share a passage."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out, passage = [], " ".join(r.choices(vocabulary, k=60))
    for i in range(n):
        base = r.choices(vocabulary, k=r.randint(40, 200))
        out.append(" ".join(base))
        for k in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(k):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
        out.append(" ".join(r.choices(vocabulary, k=20)) + " " + passage)
    out += [out[0], out[0].upper(), out[3]]
    chain = r.choices(vocabulary, k=120)
    for _ in range(30):
        chain[r.randrange(len(chain))] = r.choice(vocabulary)
        out.append(" ".join(chain))
    return out


def test_estimates_match_jaccard():
    t = texts(40)
    sets, sigs = N.fingerprint(t)
    x = sigs.view(np.uint16)
    err = []
    for i in range(0, 200, 5):
        a, b = shingles(t[i]), shingles(t[i + 2])
        true = len(a & b) / len(a | b)
        assert abs(N.jaccard([t[i]], [t[i + 2]])[0] - true) < 1e-9
        err.append((x[i] == x[i + 2]).mean() - true)
    assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.06
    assert len(set(sets)) == len({frozenset(shingles(s)) for s in t})


def test_weighted_registers():
    # a shingle of weight w holds w times as many registers as one of weight 1
    held = np.concatenate([N.registers(np.zeros(2, dtype=np.int64), np.array([10 + i, 1000 + i], dtype=np.uint64), np.array([1.0, 3.0]), 1)[0] >= 1000 for i in range(60)])
    assert abs(held.mean() - 0.75) < 0.02


def counted(text, k=5):
    w = text.split()
    return {s: 1 + np.log(c) for s, c in Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))).items()}


def probability_jaccard(u, v):
    return sum(1 / sum(max(u.get(j, 0) / u[i], v.get(j, 0) / v[i]) for j in u.keys() | v.keys()) for i in u.keys() & v.keys())


def test_weighted_similarity():
    """With weights the registers estimate the probability Jaccard similarity, and the same is verified."""
    r = random.Random(8)
    err = []
    for _ in range(60):
        body, line = (" ".join(r.choices([f"w{i}" for i in range(500)], k=n)) for n in (60, 12))
        a, b = f"{body} {line}", " ".join([body[: r.randint(100, 200)], *[line] * r.randint(1, 20)])
        true = probability_jaccard(counted(a), counted(b))
        assert abs(N.jaccard([a], [b], weighted=True)[0] - true) < 1e-9
        x, y = N.fingerprint([a, b], weighted=True)[1].view(np.uint16)
        err.append((x == y).mean() - true)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06


def check(spark, rows):
    out = N.report(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    first = near_groups(rows)
    members = {}
    for i, g in enumerate(first):
        members.setdefault(g, []).append(rows[i][0])
    low = lambda v: None if any(x is None for x in v) else min(v)
    want = Counter((rows[i][0], low(members[g])) for i, g in enumerate(first) if rows[i][0] is not None)
    assert Counter((r.doc_id, r.class_id) for r in out if r.doc_id is not None) == want
    return out


def test_report_against_all_pairs(spark):
    rows = [(1000 + i, t) for i, t in enumerate(texts())]
    random.Random(3).shuffle(rows)
    out = check(spark, rows)
    sizes = Counter(r.class_id for r in out)
    assert all(r.class_size == sizes[r.class_id] for r in out)
    assert Counter(r.class_id for r in out if r.kept) == Counter(dict.fromkeys(sizes, 1))


def test_edge_cases(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] != 3] + [(30, "one two"), (31, "one two"), (32, "One, TWO!")]
    # wordless texts stay alone; repeated rows are alike
    out = N.report(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in out} == {1: 1, 2: 2, 4: 4, 5: 5, 6: 6, 7: 7, 30: 30, 31: 30, 32: 30}
    assert sum(r.kept for r in out) == len(rows) - 2
    assert N.report(docs(spark, [])).count() == 0
    df = docs(spark, ODD)
    assert N.dedup(df).columns == df.columns and N.dedup(df.limit(0)).count() == 0


def near_pairs(rows, similarity=0.8):
    own = [shingles(t) for _, t in rows]
    return {(i, j) for i, a in enumerate(own) for j, b in enumerate(own[:i]) if len(a & b) >= similarity * len(a | b) and a != b}


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_leftover_finds_every_link(spark, block):
    """Without any star, the comparisons of what is left over find the links of all pairs, in buckets or by the rarest shingles."""
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t) for i, t in enumerate([*texts(30, 5), *(" ".join(r.choices([f"u{i}" for i in range(3000)], k=40)) + " " + passage for _ in range(60))])]
    df = docs(spark, rows)
    found = N.cut(N.classes(df))
    reps = N.representatives(found)
    none = spark.createDataFrame([], "set long, root long, center long, wide boolean")
    got = {(x.a, x.b) for x in N._leftover(N.buckets(reps), reps, none, df, 0.8, "text", block=block).collect()}
    of = {x.doc_id: x.set for x in found.join(reps.select("digest", "set"), "digest").collect()}
    want = {tuple(sorted((of[rows[i][0]], of[rows[j][0]]))) for i, j in near_pairs(rows)}
    assert got == want and len(want) > 50


def test_near_clique(spark):
    """All of a group of mutually near texts and of a chain are one class, whatever leaders are drawn."""
    r = random.Random(10)
    base = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if k == r.randrange(200) else w for k, w in enumerate(base))) for i in range(120)]
    check(spark, rows)


def test_shared_passages(spark):
    """Texts with one passage in common are no near copies; the near copies among them are found."""
    r = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(80))
    own = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(700):
        t = f"{own(40)} {passage}"
        rows.append((2 * i, t))
        if i % 10 == 0:
            rows.append((2 * i + 1, t + " more"))
    out = check(spark, rows)
    assert sum(x.class_size == 2 for x in out) == 140


def test_dedup_keeps_one_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (5, long), (9, long + " x"), (9, long + " x"), (7, "!!!"), (7, "!!!"), (8, "alone here"), (8, "alone here"), (None, "null id"), (None, "null id")]
    df = docs(spark, rows)
    out = N.dedup(df)
    assert out.columns == df.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter({(5, long): 1, (7, "!!!"): 2, (8, "alone here"): 1, (None, "null id"): 1})


def test_hot_group(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(700):
        copy = list(base)
        if i:
            copy[r.randrange(150)] = f"z{i}"
            copy[r.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    out = N.report(docs(spark, rows + [(9000 + i, rows[0][1]) for i in range(300)])).collect()
    assert {x.class_id for x in out} == {0} and sum(x.kept for x in out) == 1


def test_repeated_lines(spark):
    """A line that is repeated adds few shingles; the copies are near however often it stands there."""
    r = random.Random(4)
    rows = []
    for k in (2, 3, 5, 10, 20, 50, 100, 200):
        for _ in range(3):
            body, line = (" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (60, 20))
            once, more = f"{body} {line}", f"{body} " + " ".join([line] * k)
            assert N.jaccard([once], [more])[0] >= 0.94
            x, y = N.fingerprint([once, more])[1].view(np.uint16)
            assert (x == y).mean() > 0.8
            rows += [(2 * len(rows), once), (2 * len(rows) + 1, more)]
    out = check(spark, rows)
    assert all(x.class_size == 2 for x in out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents_against_all_pairs(spark):
    """All links of the test documents, copies and short texts among them, compared pair by pair."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = check(spark, rows)
    assert sum(x.class_size > 1 for x in out) > 100
