import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
from helpers import ODD, contamination, docs, words

from tidegauge.llm import decontamination as D

ITEMS = "item_id long, text string, doc_id long"


def sample(seed=2):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["É", "straße"]
    items = [(i, " ".join(r.choices(v, k=k))) for i, k in enumerate([1, 3, 9, 10, 11, 15, 30, 30, 12])] + [(50, None), (51, "..."), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    items.append((60, items[6][1]))  # equal items
    rows = list(ODD)
    for i in range(200):
        t = r.choices(v[5:], k=r.randint(0, 60))
        if i % 3 == 0:
            w = items[r.randrange(9)][1].split()
            t[5:5] = w[: r.randint(1, len(w))]
        if i % 7 == 0:
            t += items[6][1].upper().split()
        rows.append((100 + i, ", ".join(t)))
    return rows, items


def test_against_a_scan(spark):
    rows, items = sample()
    df = docs(spark, rows)
    out = D.report(df, spark.createDataFrame([(*i, 0) for i in items], ITEMS)).collect()
    want = Counter()
    for i, t in rows:
        n, hit, found = contamination(t, items)
        want[i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    left = D.drop_contaminated(df, spark.createDataFrame([(*i, 0) for i in items], ITEMS))
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((i, t) for i, t in rows if not contamination(t, items)[1])


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated for r in D.report(docs(spark, ODD), none).collect())
    assert D.report(docs(spark, []), spark.createDataFrame([(1, "a b", 0)], ITEMS)).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha b c d e f g h i omega", 0)], ITEMS)
    rows = [(1, "alpha b c d e f g h i omega"), (2, "alpha b x c d e f g h i omega"), (3, "alpha b x y z c d e f g h i omega"), (4, "alpha omega b c d e f g h i"), (5, "alpha zz c d e f g h i omega"), (6, "alpha b c d e"), (7, None)]
    out = {r.doc_id: r for r in D.report(docs(spark, rows), items, slack=1).collect()}
    assert {i: r.near_gap for i, r in out.items()} == {1: 0, 2: 1, 3: None, 4: 1, 5: 0, 6: None, 7: None}
    assert {i for i, r in out.items() if r.contaminated} == {1}
    assert all(r.near_items == (["1"] if r.near_gap is not None else []) and r.n_near == len(r.near_items) for r in out.values())


def test_many_terms_are_joined_by_shuffle(spark, monkeypatch):
    rows, items = sample(4)
    df, it = docs(spark, rows), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    few = Counter(map(str, D.report(df, it, slack=1).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert Counter(map(str, D.report(df, it, slack=1).collect())) == few


def nearly(text, items, slack, size=10):
    """{item id: least gap} by trying every start: all words of a window near their places, but for one in a full window."""
    w, out = words(text), {}
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        n = min(size, len(v))
        for i in range(len(v) - n + 1):
            for g in range(slack + 1):
                for s in range(-n - g, len(w) + g + 1):
                    if sum(v[i + k] in w[max(0, s + k - g) : max(0, s + k + g + 1)] for k in range(n)) >= n - (n >= size):
                        out[str(item)] = min(g, out.get(str(item), g))
    return out


def test_near_copies(spark):
    base = [f"p{i}" for i in range(30)]
    rows = [(1, " ".join(base)), (2, " ".join(base[1:4] + ["p9"])), (8, " ".join(base[::2])), (9, " ".join(base[::-1]))]
    # every tenth word replaced by one that no item has, put in, left out
    rows += [(3, " ".join("zz" if i % 10 == 5 else w for i, w in enumerate(base))), (4, " ".join(f"{w} zz" if i % 10 == 5 else w for i, w in enumerate(base)))]
    rows += [(5, " ".join(w for i, w in enumerate(base) if i % 10 != 5)), (6, "p0 p29 p1 p28"), (7, " ".join(base[1:10]))]
    items = [(1, rows[0][1]), (2, "p3 zero"), (3, "p9")]
    # an item with a word that no document holds
    items.append((4, " ".join(["unseen" if i == 4 else w for i, w in enumerate(base[12:22])])))
    more, odd = sample(3)
    more = [x for x in more if len(x[1] or "") < 1000][:50]
    slack = 1
    r = {x.doc_id: x for x in D.report(docs(spark, rows), spark.createDataFrame([(*i, 0) for i in items], ITEMS), slack).collect()}
    assert all("1" in r[i].near_items for i in (1, 3, 4, 5, 7)) and "4" in r[1].near_items and r[9].near_items == ["3"]
    for given, it in ((rows, items), (more, odd)):
        out = D.report(docs(spark, given), spark.createDataFrame([(*i, 0) for i in it], ITEMS), slack).collect()
        want = Counter((i, tuple(sorted(n := nearly(t, it, slack))), min(n.values(), default=None)) for i, t in given)
        assert Counter((x.doc_id, tuple(x.near_items), x.near_gap) for x in out) == want
        assert all(x.n_near == len(x.near_items) for x in out)
        # the oracle's SQL says the same
        documents, benchmark = (pd.DataFrame(x, columns=c).astype({c[0]: "Int64"}) for x, c in ((given, ["doc_id", "text"]), (it, ["item_id", "text"])))
        with duckdb.connect() as db:
            db.register("documents", documents)
            db.register("benchmark", benchmark)
            told = db.sql(D.SQL).fetchall()
        assert Counter((x[0], x[6], x[7], x[8]) for x in told) == Counter((i, len(n := nearly(t, it, slack)), ",".join(sorted(n)), min(n.values(), default=-1)) for i, t in given)
