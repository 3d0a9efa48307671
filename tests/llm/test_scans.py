import hashlib
import os
import random
import re
from collections import Counter

import pytest
from helpers import ODD, docs
from pyspark.sql import functions as F

from tidegauge.llm import secret_scan as S
from tidegauge.llm import url_filter as U
from tidegauge.llm.common import folds, table

SF = "/root/testdata/sf0.01"

LITERAL = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
}


def plain(text):
    found = []
    for k, (kind, (p, ok)) in enumerate(LITERAL.items()):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def secrets():
    r = random.Random(4)
    bits = ["token", "PASSWORD", "passwd", "Secret", "api_key", "apikey", "ApiKey", " = ", ":", '"', "'", "=", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "x/y+z.w-1_2=", "é", "\n", " ", "ſecret", "deadbeefdeadbeef00", "0" * 15, "token: password: abcdefghijklmnop"]
    return ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(400)]


def test_spans(spark):
    rows = [*ODD, *((1000 + i, t) for i, t in enumerate(secrets()))]
    out = S.scan(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        spans = plain(t or "")
        n = Counter(k for k, _, _ in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    for r in out:  # the model adds spans; the others stay
        own = r.spans.split(",") if r.spans else []
        assert len(own) == r.n_assign + r.n_access + r.n_hex + r.n_model
    assert S.scan(docs(spark, [])).count() == 0


ORDINARY = "getUserNameFromIndexPage set_default_configuration_value org/apache/spark/sql/functions AbstractSingletonProxyFactoryBean internationalization Donaudampfschifffahrtsgesellschaft application/x-www-form-urlencoded ----------------------------- /usr/local/lib/python3/dist-packages xxxxxxxxxxxxxxxxxxxxxxxxx CONTENT_SECURITY_POLICY_REPORT_ONLY".split()


def test_model_tells_random_from_ordinary():
    model = S.fit()
    secret, ordinary = S.samples(99, 3000)
    found = lambda x: bool(S.model_spans(x, model, []))
    assert sum(map(found, secret)) / len(secret) > 0.95
    assert sum(map(found, ordinary)) / len(ordinary) < 0.01
    assert not any(map(found, ORDINARY))
    text = "id ghp_16C7e42F292c6912E7710c838347Ae178B4a and get_user_name_from_index_page_1"
    assert [text[a:b] for a, _, b in S.model_spans(text, model, [])] == ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    # behind a long path only the end is random; letters alone; beside a base span
    path = "/usr/share/get_name/index/page/static/content/" + "x7Kq9TzB3mWf8RvL2pYd"
    (a, _, b), = S.model_spans(path, model, [])
    assert b == len(path) and 40 <= a <= 50
    assert found("QwXzKpVbNtRjLmGhYcFdSq")
    text = "0123456789abcdef0123" + "Zq8Rt5Yw2Xc7Vb1Nm4Lk9"
    base = S.base_spans(text)
    assert base and all(a >= base[0][2] for a, _, b in S.model_spans(text, model, base)) and S.model_spans(text, model, base)


def test_stretches_against_all_sums():
    """Every stretch is as good as any of its beginnings and ends, and none that is far above the bounds is missed."""
    r = random.Random(3)
    for _ in range(200):
        score = S.np.array([r.uniform(-1, 1.5) + S.MARGIN for _ in range(r.randint(0, 80))])
        got = S.stretches(score)
        own = score - S.MARGIN
        for a, b, total in got:
            assert abs(own[a:b].sum() - total) < 1e-9 and b - a >= S.KERNEL and total >= S.EVIDENCE
            assert all(own[a:k].sum() > 0 for k in range(a + 1, b)) and all(own[k:b].sum() >= -1e-9 for k in range(a, b))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        sums = [(own[a:b].sum(), a, b) for a in range(len(own)) for b in range(a + S.KERNEL, len(own) + 1)]
        if sums and max(sums)[0] >= S.EVIDENCE:
            top, a, b = max(sums)
            assert any(s < b and a < e for s, e, _ in got)


def test_learned_from_documents(spark):
    """Counts come from the spans of the fixed patterns and from the runs outside of them; secrets of other documents are found."""
    r = random.Random(7)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [(i, f'ordinary_words here token = "{hexes(40)}" and Zusammengehörigkeit') for i in range(50)] + list(ODD)
    random_, ordinary = S.observe(docs(spark, rows))
    assert random_.sum() >= 50 * 40 and ordinary.sum() > 0
    at = {c: i for i, c in enumerate(S.ALPHABET)}
    assert random_[:, [at["z"], at["Q"]]].sum() == 0 and ordinary[at["d"], at["i"]] >= 50
    model = S.fit(docs(spark, rows))
    assert all(S.model_spans(hexes(40), model, []) for _ in range(50)) and not any(S.model_spans(x, model, []) for x in ORDINARY)
    assert (S.fit(docs(spark, [])) == S.fit()).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    """Fitted on half of the documents, the model alone finds the other half's secrets and adds nothing to their ordinary text."""
    d = table(spark, SF, "documents")
    model = S.fit(d.filter(folds(2, 0)))
    secrets, found, added = 0, 0, 0
    for x in d.filter(~folds(2, 0)).collect():
        base = S.base_spans(x.text or "")
        added += len(S.model_spans(x.text or "", model, base))
        for s, e in S._merged(base):
            secrets += 1
            found += bool(S.model_spans(re.sub(r"^.*[:= \"']", "", x.text[s:e]), model, []))
    assert secrets > 10 and found >= 0.95 * secrets and added == 0


def test_long_texts_with_many_spans():
    """The time grows with the text: many base spans and runs, one unbroken run."""
    import time

    model = S.fit()
    took = []
    for n in (2000, 8000):
        text = " ".join(f"{i:020x} get_user_name_{i}_from_index_page" for i in range(n)) + "x" * n
        began = time.perf_counter()
        base = S.base_spans(text)
        more = S.model_spans(text, model, base)
        took.append(time.perf_counter() - began)
        assert len(base) >= n and S._merged(sorted(base + more)) == sorted((s, e) for s, _, e in base + more)
    assert took[1] < 10 * took[0] + 0.5


URLS = [None, "", "no scheme", "http://Example.NET/en/x", "http://example.net/", "http://example.net", "https://a.b.net/x?q=1#f", "ftp://fr.example.org/fr/", "http://example.org/fr", "http://xexample.com/de/", "http://w.example.com/de/1", "http://example.com/den", "x://://y/z", "http://h?x=/net/", "http://net/", "http://İ.net/A"]


def judged(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = max(((len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark):
    pages = spark.createDataFrame([(i % 9 if i else None, u, "h", "clash", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string, _row long")
    out = U.judge(pages).collect()
    want = Counter((i % 9 if i else None, *judged(u)[:3]) for i, u in enumerate(URLS * 2))
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in out) == want
    verdict = {r[2]: v for *r, v in [("", "", h + p, v) for h, p, v in U.RULES]}
    assert all(r.verdict == verdict[r.rule] for r in out if r.rule)
    assert all(r.verdict in ("allow", "block") for r in out)
    assert U.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(pages.filter("url like 'http://h%'")).collect()} == {"allow"}


def test_rules_against_counts(spark):
    """Learned verdicts follow the best rule by confidence, found by counting all token subsets."""
    r = random.Random(6)
    labelled = [(i, sorted(r.sample("abcdef", r.randint(1, 4)))) for i in range(300)]
    rows = [(i, t, r.choice(["r1", "r2", "r3"]) if t[0] != "c" else "r1", "block" if "a" in t and "b" in t or r.random() < 0.1 else "allow") for i, t in labelled]
    df = spark.createDataFrame(rows, "_row long, tokens array<string>, rule string, verdict string")
    rules, named = U.learn(df, 0.02, 0.6)
    got = {x["_row"]: (x.learned, x.learned_rule) for x in U.match(U.as_items(df, named, []), rules, named).collect()}
    from itertools import combinations

    stats = {}
    for k in range(1, 5):
        for s in combinations("abcdef", k):
            own = [v for _, t, _, v in rows if set(s) <= set(t)]
            for v in ("block", "allow"):
                by = {h for _, t, h, w in rows if set(s) <= set(t) and w == v}
                if own and own.count(v) / 300 >= 0.02 and own.count(v) / len(own) >= 0.6:
                    stats[s, v] = (own.count(v) / len(own), own.count(v) / 300, len(by))
    # a rule that one token less serves as well never has the last word, whether or not the shorter one is proven
    plain = {k: x for k, x in stats.items() if not any(stats.get((tuple(c for c in k[0] if c != g), k[1]), (0,))[0] >= x[0] for g in k[0])}
    for i, t, _, _ in rows:
        fits = [(round(c, 9), round(s, 9), -len(k), v) for (k, v), (c, s, by) in plain.items() if set(k) <= set(t) and by >= 2]
        if not fits:
            assert i not in got
        else:
            top = max(fits)[:3]
            assert got[i][0] in {v for c, s, n, v in fits if (c, s, n) == top}


def test_evidence_of_one_rule_is_not_enough(spark):
    """A token that is seen under one hand-written rule teaches nothing; one that two of them block does."""
    urls = [f"http://{h}.example.{t}/{p}/{i}" for i in range(20) for h in ("a", "b") for t, p in (("net", "de"), ("com", "de"), ("net", "en"), ("com", "fr"), ("org", "de"), ("org", "es"))]
    out = {x.page_id: x for x in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        if ".com/fr" in u or ".org/es" in u:
            assert out[i].rule is None and out[i].verdict == "allow"
        if ".org/de" in u:  # blocked under net/ and under example.com/de/
            assert out[i].rule is None and out[i].verdict == "block" and out[i].learned_rule == "p:de"


def test_urls_of_many_tokens(spark):
    """Keys that always come together count as one token; of others a URL gives the miner its most frequent ones only."""
    keys = "&".join(f"k{i}=1" for i in range(60))
    r = random.Random(1)
    urls = [f"http://x.net/{i}?{keys}" for i in range(40)] + [f"http://h{i}.example.com/de/{i}?{keys}" for i in range(40)] + [f"http://y.org/a?{keys}", "http://y.org/b?k3=1", "http://z.org/c"]
    out = {x.page_id: x for x in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [out[i].verdict for i in range(80, 83)] == ["block", "block", "allow"]
    rows = [(i, [f"t{k:02}" for k in range(40) if r.random() < 0.9] + ["rare"] * (i == 3), f"r{i % 2}", "block" if i % 5 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows, "_row long, tokens array<string>, rule string, verdict string")
    named = U.bundles(df)
    items = U.as_items(df, named, ["rule", "verdict"])
    n = Counter(t for _, ts, _, _ in rows for t in ts)
    got = {x["_row"]: x["items"] for x in items.select("_row", U.narrowed(2.0, 5).alias("items")).collect()}
    assert got == {i: sorted((t for t in ts if n[t] >= 2), key=lambda t: (-n[t], t))[:5] for i, ts, _, _ in rows}
    # what is mined from a part is counted over all rows and tokens
    rules = U.mine(items, named, 0.01, 0.6, together=3).collect()
    assert rules
    for x in rules:
        own = [v for _, ts, _, v in rows if set(x["items"]) <= set(ts)]
        assert abs(x.confidence - own.count(x.learned) / len(own)) < 1e-9 and abs(x.support - own.count(x.learned) / 200) < 1e-9


def test_one_url_changes_no_other(spark):
    """A URL that holds many tokens of others, each frequent, leaves the rules and all other verdicts as they were."""
    r = random.Random(2)
    names = [f"common{i}" for i in range(20)]
    urls = [f"http://h{i % 9}.{'net' if i % 2 else 'example.com'}/{'' if i % 2 else 'de/'}{'promo/' if i % 7 < 2 else 'x/'}{i}?" + "&".join(f"{k}=1" for k in r.sample(names, 2)) for i in range(1200)]
    urls += [f"http://h{i % 9}.org/fr/x/{i}?" + "&".join(f"{k}=1" for k in r.sample(names, 2)) for i in range(900)]
    urls += [f"http://h{i % 9}.example.net/en/x/{i}" for i in range(300)] + [f"http://other{i}.info/promo/{i}" for i in range(50)] + [f"http://other{i}.info/x/{i}" for i in range(50)]
    odd = "http://odd.net/promo/y?" + "&".join(f"{k}=1" for k in names)

    def verdicts(given):
        return {x.page_id: (x.rule, x.verdict, x.learned_rule) for x in U.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()}

    before, after = verdicts(urls), verdicts([*urls, odd])
    assert all(before[len(urls) - 100 + i][1] == "block" and before[len(urls) - 100 + i][2] for i in range(50))
    assert {k: v for k, v in after.items() if k < len(urls)} == before and after[len(urls)][1] == "block"
