"""Small tables and plain versions of the operators' rules."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set string, _n long, size int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones; rows are (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "clash", 7, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(None, None), (None, ""), (1, None), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "\x00퟿ \U0001f600 é"), (5, "x" * 30_000), (6, "word " * 20_000), (7, "!!! ... ***")]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k=5):
    w = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(rows, similarity=0.8):
    """Connected components of Jaccard similarity, compared pair by pair: index -> smallest index."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def contamination(text, items, size=10):
    """(n_words, n_hit, item ids) by scanning every position for every window."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        n = min(size, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)
