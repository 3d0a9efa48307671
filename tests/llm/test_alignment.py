import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, docs

from tidegauge.llm import alignment as A


@pytest.fixture(scope="module")
def pair():
    a, b = A.default_paths()
    with open(b, "rb") as f:
        return A.Pair(A.read_spec(a), f.read())


def plain(pair, texts):
    """Every text by itself: whole texts through both libraries, cuts and links by walking both rows of ends."""
    found, held = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = pair.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = pair.b.encode(t or "")
        if not t or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            found.append(None)
            continue
        groups, links, i, j, x, y = [([], [])], [], 0, 0, len(pair.a_bytes[a[0]]), len(pair.b_bytes[b[0]])
        groups[0][0].append(a[0])
        groups[0][1].append(b[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = x <= y, y <= x
            if step_a and step_b:
                if i + 1 == len(a):
                    break
                groups.append(([], []))
            if step_a:
                i += 1
                x += len(pair.a_bytes[a[i]])
                groups[-1][0].append(a[i])
            if step_b:
                j += 1
                y += len(pair.b_bytes[b[j]])
                groups[-1][1].append(b[j])
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        signs = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(held[p] == best[p[0]] for p in f[3]), sum(held[p] for p in f[3]), hashlib.sha256(signs.encode()).hexdigest()))
    return out


STRANGE = ["a b", " a", "a ", "  ", " ", "\n", "\n\na\n b \n", "a\tb\r\nc\r\n\r\n  d", "x\xa0 y  z 　", "<|endoftext|> <s></s><unk> <0x41>", "▁ is a mark", "a▁b", "\x00\x01 \x1c \x85", "don't we'll 1234 ½", "日本語 текст \U0001f600\U0001f468‍\U0001f469", "éé ﬁ Å", "[INST] ;\r x", "͸ \U000e0001", "a\r\n b"]


def fuzz(seed, n):
    rng = random.Random(seed)
    letters = list(" \n\t\r\xa0 ​▁aAbé日;\U0001f600'1.\x1c\x00") + ["  ", "\n\n", " the", "ing", "<s>", "<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_bitsets():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(n) < 0.3)
        bits = A.packed(at, n)
        assert list(A.selected(bits)) == list(at)
        assert list(A.ranks(bits, np.arange(n))) == [int((at < i).sum()) for i in range(n)]


def test_chunks_are_encoded_like_whole_texts(pair):
    for t in STRANGE + fuzz(1, 3000):
        parts = A.chunks_of(" " + t)
        assert "".join(parts) == " " + t
        assert [i for x in pair.encode_a(parts) for i in x] == pair.a.encode(" " + t, add_special_tokens=False).ids, t
        if "▁" not in t:  # B reads that as a space, so its bytes are never the text's
            assert [i for x in pair.encode_b(parts) for i in x] == pair.b.encode(t), t


def test_report(spark, pair):
    texts = STRANGE + fuzz(2, 200)
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts)] + [(900, texts[5]), (901, texts[5]), (901, texts[5])]
    for size in (0, 2_000):  # one block for each task, and many
        got = Counter(map(tuple, A.report(docs(spark, rows).repartition(3), size=size).collect()))
        assert got == Counter((i, *p) for (i, _), p in zip(rows, plain(pair, [t for _, t in rows]), strict=True))
    assert A.report(docs(spark, [])).count() == 0


def test_links(spark, pair):
    rows = [(1, "The cat sat, unbelievably."), (2, None), (3, "a▁b")]
    got = {r.doc_id: r.groups for r in A.links(docs(spark, rows)).collect()}
    assert got[2] == got[3] == []
    a = [i for g in got[1] for i in g.a]
    assert a == pair.a.encode(" " + rows[0][1], add_special_tokens=False).ids and [i for g in got[1] for i in g.b] == pair.b.encode(rows[0][1])
    for g in got[1]:
        assert b"".join(pair.a_bytes[i] for i in g.a) == b"".join(pair.b_bytes[i] for i in g.b)


def test_other_files_are_refused(pair):
    with open(A.default_paths()[1], "rb") as f:
        model = f.read()
    spec = A.read_spec(A.default_paths()[0])
    with pytest.raises(ValueError):
        A.Pair(spec.replace('"normalizer":null', '"normalizer":{"type":"Lowercase"}').replace('"normalizer": null', '"normalizer": {"type": "Lowercase"}'), model)
