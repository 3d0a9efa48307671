import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, docs

from tidegauge.llm import suffix_array as A
from tidegauge.llm import suffix_dedup as S


def plain(texts, length):
    """(bytes, removed, runs, digest of the rest) of each text by counting all strings."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, upto = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[max(i, upto) : i + length] = b"\1" * (i + length - max(i, upto))
                upto = i + length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for depth in (8, 24, 200):
        for n in (1, 2, 7, 60, 500):
            t = rng.integers(0, letters, n).astype(np.uint8)
            t = np.tile(t, 3) if n == 60 else t
            wanted = rng.random(len(t)) < rng.choice([0.2, 1.0])
            order, w = A.suffix_array(t, wanted, depth), A.words(t, depth)
            cut = [t[i : i + depth].tobytes().ljust(depth, b"\0") for i in order]
            assert sorted(order) == list(np.flatnonzero(wanted)) and cut == sorted(cut)
            shared = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(cut, cut[1:], strict=False)]
            assert list(A.common_prefixes(w, order, depth)) == shared
    assert len(A.suffix_array(np.zeros(0, np.uint8), np.zeros(0, bool), 8)) == 0


def test_only_smaller_suffixes_are_sorted_directly(monkeypatch):
    """The rest is induced."""
    t = np.frombuffer(b"the cat sat on the mat and the cat sat", np.uint8)
    given = []
    direct = A.sort_directly
    monkeypatch.setattr(A, "sort_directly", lambda w, starts, depth: given.extend(starts) or direct(w, starts, depth))
    A.suffix_array(t, np.ones(len(t), bool), 16)
    b = t.tobytes()
    assert given == [i for i in range(len(b)) if b[i:] < b[i + 1 :]] and len(given) < len(b)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    line = " ".join(word() for _ in range(70))
    rows = list(ODD)
    for i in range(60):
        body = [word() for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body)), line)
        rows.append((100 + i, " ".join(body)))
    rows += [(200 + i, rows[20][1] + " " + word()) for i in range(5)] + [(300, rows[30][1]), (301, rows[30][1])]
    return rows + [(400, "ab" * 400), (401, "y" * 199), (402, "y" * 200), (403, line[:250] + line[:250]), (404, line[:199])]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_report(spark, monkeypatch, hot):
    """Against counts of all strings, with pieces of common anchors split too."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus()
    got = S.report(docs(spark, rows)).collect()
    want = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], 200), strict=True)]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    for r in got:
        ends = list(r.spans)
        assert ends == sorted(set(ends)) and sum(b - a for a, b in zip(ends[::2], ends[1::2], strict=True)) == r.n_removed


def test_other_length_and_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(S, "HASHED_BYTES", 1 << 10)
    monkeypatch.setattr(S, "SORTED_BYTES", 1 << 10)
    rows = corpus()
    got = S.report(docs(spark, rows), length=100).collect()
    want = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], 100), strict=True)]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    with pytest.raises(ValueError):
        S.report(docs(spark, rows), length=64)


def test_dedup_keeps_columns(spark):
    rows = corpus()
    df = docs(spark, rows).withColumnRenamed("set", "digest")
    out = S.dedup(df)
    assert out.columns == [*df.columns, "kept"]
    sha = Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())
    assert sha == Counter((i, p[3]) for (i, _), p in zip(rows, plain([t for _, t in rows], 200), strict=True))
    assert S.dedup(df.limit(0)).count() == 0 and S.report(df.limit(0)).count() == 0


def test_a_common_line_does_not_meet_in_one_group(spark, monkeypatch):
    """Every text holds one line: no key keeps more than HOT different pieces for a sort."""
    monkeypatch.setattr(S, "HOT", 20)
    rng = random.Random(5)
    line = " ".join(str(rng.randrange(10**6)) for _ in range(50))
    rows = [(i, f"{rng.random()} {rng.random()} {line} {rng.random()} {rng.random()}" * 1) for i in range(300)]
    sizes = []
    kept = S._marks

    def marks(pieces, counts, length, parts):
        sizes.append((counts.agg({"n": "max"}).first()[0], parts))
        return kept(pieces, counts, length, parts)

    monkeypatch.setattr(S, "_marks", marks)
    got = S.report(docs(spark, rows)).collect()
    want = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], 200), strict=True)]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    assert sizes[0][0] > 20 and sizes[-1] == (1, ())
