import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, docs

from tidegauge.llm import collocation as C


def plain(rows, longest=4, support=30, within=80, first=2000):
    """All phrases counted one by one: rows are (id, text, lang)."""
    total, f = Counter(), Counter()
    for r in rows:
        lang = r[2] if len(r) > 2 and r[2] is not None else "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(lang == m and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= within * a for (m, q), b in found.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return Counter((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first]))  # noqa: E741


def rows(seed=1, n=900):
    rng = random.Random(seed)
    vocab = ["the", "Cat", "sat", "é", "Ä", "on", "　x", "a\x00b", "ab", "mat"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    out = []
    for i in range(n):
        w = rng.choices(vocab, weights, k=rng.randint(0, 60))
        if i % 4 == 0:
            w += ["New", "york", "city", "council"] * (i % 3) + ["new", "york"]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]) for x in w)
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return out


def got(df):
    return Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_against_plain_counts(spark):
    data = [(*r, None) for r in ODD] + rows()
    want = plain(data)
    assert len(want) > 25 and {w[0] for w in want} == {"en", "de", "und"}
    assert got(C.collocations(docs(spark, data).repartition(5))) == want


def test_other_parameters_and_small_blocks(spark, monkeypatch):
    """Blocks of a few texts, many ranges, and the first few phrases only."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(C, "CUT_BYTES", 500)
    monkeypatch.setattr(C, "RANGE_PAIRS", 300)
    data = rows(2)
    for longest, support, within, first in ((3, 10, 60, 7), (2, 12, 80, 2000)):
        want = plain(data, longest, support, within, first)
        assert want and got(C.collocations(docs(spark, data).repartition(3), longest=longest, support=support, within=within, first=first)) == want


def test_ids_lead_to_all_parts(spark):
    total, levels = C.phrases(docs(spark, rows(3)), support=10)
    names = [{r.id: r for r in x.collect()} for x in levels]
    assert all(names)
    for k, level in enumerate(names[1:], start=2):
        for r in level.values():
            w = r.phrase.split(" ")
            assert names[k - 2][r.left].phrase == " ".join(w[:-1]) and names[k - 2][r.right].phrase == " ".join(w[1:])
            assert len(r.firsts) == len(r.lasts) == k == len(w) and r.firsts[-1] == r.lasts[-1] == r.a


def test_edges(spark):
    assert C.collocations(docs(spark, [])).count() == 0
    assert C.collocations(docs(spark, [(1, None), (2, ""), (3, " . , ")])).count() == 0
    same = [(None, "go on " * 20, None), (7, "go on. " * 40, "xx")] * 2
    assert got(C.collocations(docs(spark, same))) == plain([(i, t, lang) for i, t, lang in same])


def test_counts_beyond_64_bits(spark):
    """Twice the scale times a count that fits 64 bits doesn't."""
    big = 9_000_000_000_000_000_000
    one = spark.createDataFrame([(0, "xx", "a", big, [big], [big]), (1, "xx", "b", big, [big], [big])], "id long, lang string, phrase string, a long, firsts array<long>, lasts array<long>")
    two = spark.createDataFrame([(0, "xx", "a b", big - 1, [big, big - 1], [big, big - 1], 0, 1)], "id long, lang string, phrase string, a long, firsts array<long>, lasts array<long>, left long, right long")
    r = C.candidates([one, two]).collect()
    assert [(x.a, x.l, x.r, x.score) for x in r] == [(big - 1, big, big, 2_000_000 * (big - 1) // (2 * big))]


def test_sequences():
    assert list(C.squeezed(np.array([-1, 3, -1, -1, 4, 5, -1, 6]))) == [4, 5, -1]
    left, right, n, seq = C.pairs_of(np.array([4, 5, 4, 5, -1, 5, 4], dtype=np.int32))
    assert list(zip(left, right, n, strict=True)) == [(4, 5, 2), (5, 4, 2)] and list(seq) == [0, 1, 0, -1] or list(seq) == [0, 1, 0]


def test_numbers_follow_the_order_of_ids():
    """First ids used to be in no order, and took most of what blocks send beside the second ones."""
    rng = np.random.default_rng(4)
    gids = rng.permutation(np.arange(5_000, dtype=np.int64) + (3 << 32))
    seq = rng.integers(-1, 6_000, 40_000).astype(np.int32)
    at = np.arange(0, 6_000, 1)[np.sort(rng.permutation(6_000)[:5_000])]
    low = np.sort(gids[:2_500]), np.sort(gids[2_500:])
    found = [{"at": C._pack_rising(at[:2_500]), "ids": C._pack_rising(low[1], np.int64)}, {"at": C._pack_rising(at[2_500:]), "ids": C._pack_rising(low[0], np.int64)}]
    given = C.pa.RecordBatch.from_pylist([{"block": 7, "lang": "en", "seq": C._pack(seq), "found": found}])
    (pairs,) = list(C._next_pairs(iter([given])))
    row = pairs.to_pylist()[0]
    ids, left, right = C._unpack_rising(row["gids"], np.int64), C._unpack_rising(row["left"]), C._unpack(row["right"])
    assert (ids == np.sort(gids)).all() and (np.diff(left) >= 0).all()
    name = dict(zip(at.tolist(), np.r_[low[1], low[0]].tolist(), strict=True))
    want = Counter((name[x], name[y]) for x, y in zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True) if x in name and y in name)
    assert dict(zip(zip(ids[left].tolist(), ids[right].tolist(), strict=True), C._unpack(row["freq"]).tolist(), strict=True)) == want
    asked = [r for b in C._asking(3, False)(iter([pairs])) for r in b.to_pylist()]
    sent = [(x, y) for r in asked for x, y in zip(C._unpack_rising(r["left"], np.int64).tolist(), C._unpack(r["right"], np.int64).tolist(), strict=True)]
    assert sorted(sent) == sorted(want) and all((np.diff(C._unpack_rising(r["left"], np.int64)) >= 0).all() for r in asked)
