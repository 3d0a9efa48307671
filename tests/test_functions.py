from difflib import SequenceMatcher
from itertools import combinations
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.functions import url as U
from tidegauge.operators import blocking as B
from tidegauge.operators import filters, graph, itemsets, joins, ranking, simhash


def one(spark, col, *values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


URLS = ["?a=&b=1", "http://h/?a=1&a=2", "http://h/?%66oo=1", "http://h/?a+b=1", "http://h/#x?y=1", "http://h/?b&c==", "http://h/?=1&q=%C3%A9", "http://h", "http://h/?&&", "http://h/?a=1#b=2"]


def test_query_keys(spark):
    for got, u in zip(one(spark, U.query_keys(F.col("x")), *URLS), URLS, strict=True):
        assert got == sorted(parse_qs(urlparse(u).query)), u
    assert one(spark, U.query_keys(F.col("x")), None, "", "http://h/?%zz=1") == [[], [], ["%zz"]]


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "co.uk", "example.com", "com", "10.0.0.1", "localhost", "x.y.ck", "www.ck", "a.www.ck", None, "foo.bar.example.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: r.domain for r in U.registrable_domain(df, "h").collect()}
    assert got == {"a.b.example.co.uk": "example.co.uk", "co.uk": None, "example.com": "example.com", "com": None, "10.0.0.1": None, "localhost": None, "x.y.ck": "x.y.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "foo.bar.example.com": "example.com"}


def test_cookie_names(spark):
    assert one(spark, T.cookie_names(F.col("x")), "a=1; b=2", "x=a=b", "none", None) == [["a", " b"], ["x"], [""], None]
    assert one(spark, T.cookie_names(F.col("x"), trim=True), "a=1; b=2") == [["a", "b"]]


def test_dates(spark):
    got = one(spark, T.cookie_date(F.col("x")), "Mon, 02-Jan-2006 03:04:05 GMT", "Tue, 02 Jan 06 03:04:05 GMT", "", "0", "x", None)
    assert [str(x) if x else None for x in got] == ["2006-01-02 03:04:05", "2006-01-02 03:04:05", None, None, None, None]
    assert [str(x) for x in one(spark, T.parse_time(F.col("x")), "2026-01-01T00:00:00.000Z", "junk")] == ["2026-01-01 02:00:00", "9999-12-31 23:59:59"]


@pytest.mark.parametrize(("days", "ge", "gt"), [(90 * 24, True, None), (90 * 24 + 23, True, None), (91 * 24, True, True), (89 * 24, None, None)])
def test_expiry(spark, days, ge, gt):
    a, b = F.timestamp_seconds(F.lit(days * 3600)), F.timestamp_seconds(F.lit(0))
    assert spark.range(1).select(filters.expiry_flag(a, b), filters.expiry_flag(a, b, mode="gt_whole_days")).first() == (ge, gt)


def test_null_aware_not_in(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    taken = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert {r.k for r in filters.not_in(a, taken("x"), "k").collect()} == {"y"}
    assert filters.not_in(a, taken("x", None), "k").count() == 0
    assert filters.not_in(a, taken(), "k").count() == 3


def test_update_from(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(1, "z"), (1, "b"), (2, "y")], "k int, w string")
    assert {tuple(r) for r in joins.update_from(t, s, ["k"], {"v": F.min("w")}).collect()} == {(1, "b"), (2, "y"), (3, "c")}
    assert {tuple(r) for r in joins.update_from(t, s, ["k"], {"v": F.min("w")}, guarded=True).collect()} == {(1, "a"), (2, "y"), (3, "c")}


def test_simhash(spark):
    df = spark.createDataFrame([(0, "ABCXDEF"), (1, ""), (2, "ab"), (3, None)], "k int, t string")
    got = {r.k: r.simhash & (2**64 - 1) for r in simhash.fingerprint(df, "k", "t").collect()}
    assert got[0] == 0xF2B43CF16AFDFE7F
    udf = {r.k: r.h & (2**64 - 1) for r in df.select("k", simhash.fingerprint_udf("t").alias("h")).collect()}
    assert all(udf[k] == v for k, v in got.items())
    assert simhash.bands(2) == [(0, 21), (21, 21), (42, 22)] and simhash.bands(8)[-1] == (56, 8)


def test_clusters_of_a_chain(spark):
    values = [(i, (1 << i) - 1) for i in range(40)] + [(100, -1), (101, -1)]
    df = spark.createDataFrame(values, "k long, simhash long")
    got = {r.k: r.cluster for r in simhash.clusters(df, "k", 2).collect()}
    assert {got[i] for i in range(40)} == {0} and got[100] == got[101] == 100
    assert simhash.clusters(df.limit(0), "k", 2).count() == 0


def test_dbscan(spark):
    pairs = spark.createDataFrame([(a, b) for a, b in combinations(range(5), 2)] + [(4, 9), (20, 21)], "a long, b long")
    points = spark.createDataFrame([(i,) for i in (*range(5), 9, 20, 21, 30)], "k long")
    got = {r.k: r.cluster for r in simhash.dbscan(pairs, points, "k", least=5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 0, 20: None, 21: None, 30: None}


def hold(values):
    def fine(a, b):
        m = max(len(a), len(b))
        return (not m or (a and b and abs(len(a) - len(b)) / m <= 0.25)) and SequenceMatcher(None, a, b).ratio() <= 0.6

    return len(values) > 1 and all(fine(a, b) for (_, a), (_, b) in combinations(sorted(values), 2))


def test_hold_id(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        for p in range(rng.integers(1, 5)):
            v = "".join(rng.choice(list("abcdefghijklmnop0123456789"), rng.integers(8, 12))) if c % 3 else rng.choice(["same", "", "samesame", None])
            rows.append((f"c{c % 20}", f"s{c // 20}", v, f"p{p}"))
    rows += [("", "s0", "x", "p0"), (None, "s0", "x", "p1"), ("only", "lonely", "a", "p0"), ("only", "lonely", "b", "p0")]
    df = spark.createDataFrame(rows, "name string, top_level_etld string, value string, browser_id string")
    want = {}
    for n, s, v, p in rows:
        if n and s != "lonely":
            want.setdefault((n, s), []).append((p, v or ""))
    want = {k: hold(v) for k, v in want.items()}
    assert {(r.name, r.top_level_etld): r.hold_id for r in B.hold_id(df).collect()} == want
    assert {(r.name, r.site): r.hold_id for r in B.hold_id_faithful(df).collect()} == want
    assert B.hold_id(df.limit(0)).count() == 0


def test_rules():
    r = B.parse_rule("@@||mydomain.no/artikler/$~third-party")
    assert (r.kind, r.options) == ("allow", {"third-party": False})
    assert B.parse_rule("x$domain=a.com|~b.a.com,script").domains == {"a.com": True, "b.a.com": False}
    assert [B.parse_rule(x).kind for x in ("##.spot-ad", "domain.co.uk,domain2.com#@#.ad", "!x", "", "swf|", "/re$x/")] == ["html", "html", "comment", "comment", "block", "block"]
    import re

    assert re.search(B.to_regex("swf|"), "http://example.com/annoyingflash.swf") and not re.search(B.to_regex("swf|"), "http://example.com/swf/index.html")
    assert re.search(B.to_regex("||example.com^"), "http://a.example.com:80/") and not re.search(B.to_regex("||example.com^"), "http://example.com.evil/")


def test_rule_options(spark):
    rules = B.parse_rules(spark.createDataFrame([("ads$third-party",), ("pixel$domain=a.com|~x.a.com",), ("@@ads/ok",)], "value string"))
    urls = spark.createDataFrame([("http://h/ads/1",), ("http://h/ads/ok",), ("http://h/pixel/",), ("http://h/none",)], "url string")
    blocked = lambda **k: {r.url for r in B.match_rules(urls, rules, **k).filter("blocked").collect()}
    assert blocked() == set()
    assert blocked(options={"third-party": True}) == {"http://h/ads/1"}
    assert blocked(options={"third-party": False}) == set()
    assert blocked(domain="b.a.com") == {"http://h/pixel/"} and blocked(domain="x.a.com") == set()


def test_fisher(spark):
    from math import comb

    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 0, 0, 0), (0, 0, 0, 0), (2, 8, 7, 3), (50, 450, 80, 420)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = [r.p for r in df.select(itemsets.fisher("a", "b", "c", "d").alias("p")).collect()]
    for (a, b, c, d), p in zip(tables, got, strict=True):
        n1, n2, m = a + b, c + d, a + c
        probs = {x: comb(n1, x) * comb(n2, m - x) / comb(n1 + n2, m) for x in range(max(0, m - n2), min(n1, m) + 1)}
        assert p == pytest.approx(sum(v for v in probs.values() if v <= probs[a] * (1 + 1e-7)), abs=1e-9)


def test_itemsets_against_fp_growth(spark):
    rng = np.random.default_rng(5)
    rows = [(b, f"i{i}") for b in range(200) for i in set(rng.integers(0, 8, 4).tolist())]
    df = spark.createDataFrame(rows, "b long, i string")
    got = {tuple(r["items"]): r.n for r in itemsets.fp_growth(df, "b", "i", 0.05, 3).collect()}
    lists = {}
    for b, i in rows:
        lists.setdefault(b, set()).add(i)
    want = {}
    for k in (1, 2, 3):
        for s in combinations(sorted({i for _, i in rows}), k):
            n = sum(set(s) <= v for v in lists.values())
            if n >= 10:
                want[s] = n
    assert got == want
    assert {tuple(r["items"]): r.n for r in itemsets.fp_growth(df, "b", "i", 0.05, 5).collect() if len(r["items"]) <= 3} == want


def test_split_is_exact(spark):
    df = spark.range(997)
    for ratio in (0.0, 0.1, 0.9, 1.0):
        assert ranking.split_exact(df, "id", ratio).filter("train").count() == int(997 * ratio)


def test_hits_and_betweenness(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "l long, r string")
    s = {(r.side, r.node): r.score for r in graph.hits(edges, "l", "r").collect()}
    m = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]], dtype=float)
    h = np.ones(3)
    for _ in range(200):
        h = m @ (m.T @ h)
        h /= h.sum()
    assert [s["left", str(i)] for i in (1, 2, 3)] == pytest.approx(h, abs=1e-6)
    b = {r.node: r.score for r in graph.betweenness(edges, "l", "r").collect()}
    assert b["r:b"] == pytest.approx(b["l:1"]) and b["l:3"] == 0


def paths_through(pairs):
    """Betweenness of all nodes by counting the shortest paths of each two."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    away = {}
    for s in near:
        dist, count, todo = {s: 0}, {s: 1}, [s]
        for v in todo:
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        away[s] = dist, count
    n = len(near)
    out = dict.fromkeys(near, 0.0)
    for s, t in combinations(near, 2):
        if t in away[s][0]:
            for v in near:
                if v not in (s, t) and v in away[s][0] and v in away[t][0] and away[s][0][v] + away[t][0][v] == away[s][0][t]:
                    out[v] += away[s][1][v] * away[t][1][v] / away[s][1][t]
    return {v: 2 * x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_against_all_paths(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(a), f"n{b}") for a, b in zip(rng.integers(0, 12, 26), rng.integers(0, 9, 26), strict=True)}) + [(90, "x"), (91, "x")]
    df = spark.createDataFrame(rows + [(None, "n1"), (3, None)], "l long, r string")
    want = paths_through([(f"l:{a}", f"r:{b}") for a, b in rows])
    got = {r.node: r.score for r in graph.betweenness(df, "l", "r").collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)
    few = graph.betweenness(df, "l", "r", k=5)
    assert few.count() == len(want) and few.filter("score < 0").isEmpty()
    assert graph.betweenness(df.limit(0), "l", "r").count() == 0


def quality(pairs, label):
    both = [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]
    total = sum(w for *_, w in both)
    out = {}
    for a, _, w in both:
        out[label[a]] = out.get(label[a], 0) + w
    return sum(w for a, b, w in both if label[a] == label[b]) / total - sum((x / total) ** 2 for x in out.values())


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def test_modularity_clustering(spark):
    rng = np.random.default_rng(7)
    groups = [(f"{g}{a}", f"{g}{b}", 3.0) for g in "wxyz" for a, b in combinations(range(5), 2)] + [("w0", "x0", 1.0), ("x1", "y1", 1.0), ("y2", "z2", 1.0)]
    got = {r.node: r.community for r in graph.louvain(spark.createDataFrame(groups, "a string, b string, weight double")).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "wxyz" for i in range(5)}
    assert graph.modularity(spark.createDataFrame([(x, y, w) for a, b, w in groups for x, y in ((a, b), (b, a))], "a string, b string, weight double"), spark.createDataFrame(list(got.items()), "node string, community string"), 2 * sum(w for *_, w in groups)) == pytest.approx(quality(groups, got))
    nodes = [f"n{i}" for i in range(7)]
    pairs = [(a, b, float(rng.integers(1, 6))) for a, b in combinations(nodes, 2) if rng.random() < 0.5]
    top = max(quality(pairs, {v: i for i, g in enumerate(p) for v in g}) for p in partitions(sorted({v for a, b, _ in pairs for v in (a, b)})))
    got = {r.node: r.community for r in graph.louvain(spark.createDataFrame(pairs, "a string, b string, weight double")).collect()}
    assert quality(pairs, got) >= 0.85 * top
    assert graph.louvain(spark.createDataFrame([], "a string, b string, weight double")).count() == 0


def test_near_pairs_with_any_number_of_pieces(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63, 12)
    hashes = [int(x) for x in base]
    for x in base:
        for k in (1, 2, 4, 8, 9):
            for _ in range(3):
                y = int(x) & (2**64 - 1)
                for bit in rng.choice(64, k, replace=False):
                    y ^= 1 << int(bit)
                hashes.append(y - 2**64 if y >= 2**63 else y)
    rows = list(enumerate(hashes + hashes[:5]))
    df = spark.createDataFrame(rows, "id long, simhash long")
    rep = {}
    for i, h in rows:
        rep.setdefault(h, i)
    for k, several in ((0, (1, 2)), (2, (None, 3, 5)), (8, (None, 9, 11))):
        want = {(min(a, b), max(a, b)): bin((a ^ b) & (2**64 - 1)).count("1") for a, b in combinations(rep, 2)}
        want = {(a, b, d, rep[a], rep[b]) for (a, b), d in want.items() if d <= k}
        for pieces in several:
            got = [tuple(r) for r in simhash.near_pairs(df, "id", k, pieces).collect()]
            assert len(got) == len(want) and set(got) == want
    assert {r.id: r.rep for r in simhash.members(df, "id").collect()} == {i: rep[h] for i, h in rows}


def test_running_sums(spark):
    rows = [(f"k{i:03}", (i * 7919) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(7)
    got = {r.k: (r.rank, r.cum_pct) for r in ranking.coverage(df, "k").collect()}
    total, run = sum(n for _, n in rows), 0
    for i, (k, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        run += n
        assert got[k] == (i + 1, pytest.approx(run * 100 / total, abs=1e-6))
    assert {r.n_keys for r in ranking.n_for_coverage(df.limit(0), "k", [80.0]).collect()} == {0}
    # 79.9999996 per cent isn't 80
    near = spark.createDataFrame([("a", 799_999_996), ("b", 200_000_004)], "k string, n long")
    assert [(r.target, r.n_keys) for r in ranking.n_for_coverage(near, "k", [79.0, 80.0]).collect()] == [(79.0, 1), (80.0, 2)]


def test_long_prefixes(spark):
    prefixes = [("x" * n,) for n in range(1, 1500)]
    df = spark.createDataFrame([("x" * 1400 + "y",), ("xy",), ("zz",), ("",), (None,)], "v string")
    got = {r.v: r.p for r in joins.longest_prefix(df, "v", spark.createDataFrame(prefixes, "p string"), "p").collect()}
    assert got == {"x" * 1400 + "y": "x" * 1400, "xy": "x", "zz": None, "": None, None: None}


def test_rules_of_odd_literals(spark):
    lines = [("spam-farm",), ("*pills*de",), ("a|b/",), ("/ad[0-9]+/",), ("/q./",)]
    rules = B.parse_rules(spark.createDataFrame(lines, "value string"))
    assert {r.raw: list(r.literals) for r in rules.collect()} == {"spam-farm": ["spam-farm"], "*pills*de": ["pills"], "a|b/": ["a|b/"], "/ad[0-9]+/": ["ad"], "/q./": ["q"]}
    urls = ["http://h/xspam-farmy", "http://h/PILLS/de", "http://h/pills/xde", "http://h/ad77", "http://h/qz", "http://h/SPAM-farm", "http://h/a|b/c", "http://h/none"]
    got = {r.url: r.rule for r in B.match_rules(spark.createDataFrame([(u,) for u in urls], "url string"), rules).filter("blocked").collect()}
    assert got == {urls[0]: "spam-farm", urls[2]: "*pills*de", urls[3]: "/ad[0-9]+/", urls[4]: "/q./", urls[6]: "a|b/"}


def test_values_of_a_cookie_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("c", "s", "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 12)), f"p{i % 3}") for i in range(25)]
    rows += [("d", "s", v, p) for _, _, v, p in rows[:-1]] + [("d", "s", rows[3][2][:-1] + "#", "p9")]
    df = spark.createDataFrame(rows, "name string, top_level_etld string, value string, browser_id string")
    monkeypatch.setattr(B, "PAIR_BLOCK", 4)
    assert {r.name: r.hold_id for r in B.hold_id(df).collect()} == {"c": hold([(p, v) for n, _, v, p in rows if n == "c"]), "d": False}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "k[1]", "x-y"]), max_size=3, unique=True))
def test_lookahead_rules(spark, keys):
    import re

    rule = spark.createDataFrame([(keys,)], "k array<string>").select(itemsets.lookahead_rule(F.col("k"))).first()[0]
    url = "http://h/p?" + "&".join(f"{k}=1" for k in reversed(keys))
    assert not keys or re.search(rule[1:-1], url)
    if len(keys) > 1:
        assert not re.search(rule[1:-1], "http://h/p?" + f"{keys[0]}=1")


def test_label_propagation(spark):
    cliques = [(f"{g}{a}", f"{g}{b}", 5) for g in "xy" for a, b in combinations(range(4), 2)] + [("x0", "y0", 1)]
    got = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(cliques, "a string, b string, weight long")).collect()}
    assert len({got[f"x{i}"] for i in range(4)}) == 1 and len({got[f"y{i}"] for i in range(4)}) == 1 and got["x1"] != got["y1"]


def test_minhash(spark):
    df = spark.createDataFrame([(1, [f"t{i}" for i in range(100)]), (2, [f"t{i}" for i in range(50, 150)])], "k int, s array<string>")
    a, b = (r.signature for r in simhash.minhash(df, "k", "s", 128).orderBy("k").collect())
    assert abs(sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 3) < 0.15


def test_bundlers(spark):
    from tidegauge.operators.filters import bundler

    want = {
        "Cannot find module MODULE_NOT_FOUND null:!1": "browserify_like",
        "Cannot find module MODULE_NOT_FOUND l:!1": "webpack",
        "Cannot find module MODULE_NOT_FOUND x__vitePreloady": "browserify_like",
        "Cannot find module MODULE_NOT_FOUND x__createy": "unknown",
        "Cannot find module MODULE_NOT_FOUND unloaded:!1": "unknown",
        "Cannot find module": "unknown",
        "function o (a) MODULE_NOT_FOUND": "browserify",
        "__esm": "esbuild",
        "x__esm": "unknown",
        "module.exports = require(1)": "parcel",
        "module.exports": "unknown",
        "typeof  globalThis": "rollup",
        "$fsx.r(1)": "fusebox",
        "my webpacked": "webpack",
    }
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", bundler(F.col("t")).alias("b")).collect()}
    assert got == want


def test_script_fields_are_put_together(spark):
    rows = [("u", "1", "2", "f"), ("", "https://x", "/a.js:1", "f"), (None, "", "/a.js", "https://x"), (None, None, "/a.js", "https://x"), ("", "1", "", "f"), ("", "", "7", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "u string, l string, c string, f string")
    got = [tuple(r) for r in df.select(*T.repair_script_fields(*(F.col(c) for c in "ulcf"))).collect()]
    assert got == [("u", "1", "2", "f", False), ("https://x/a.js:1", "", "", "f", True), ("https://x/a.js", "", "", "", True), ("https://x/a.js", None, "", "", True), ("", "1", "", "f", False), ("", "", "7", "", False), (None, None, None, None, False)]


def test_bodies_and_records(spark):
    rows = [(b"a=1&b=x+y%21&a=2&c", "application/x-www-form-urlencoded"), (b"\xff\x00", "image/png"), (None, None), (b"", None), (b"%zz=1&&=v", "APPLICATION/X-WWW-FORM-URLENCODED")]
    df = spark.createDataFrame(rows, "b binary, k string")
    got = [tuple(r) for r in df.select(*T.post_body(F.col("b"), F.col("k"))).collect()]
    assert got == [('{"a":["1","2"],"b":["x y!"],"c":[""]}', None), (None, '[[null,"/wA="]]'), (None, None), (None, '[[null,""]]'), ('{"":["v"],"%zz":["1"]}', None)]
    df = spark.createDataFrame([(True, False), (False, False), (None, None), (False, True)], "r boolean, s boolean")
    assert [r[0] for r in df.select(T.record_type(F.col("r"), F.col("s"))).collect()] == ["deleted", "added-or-changed", "added-or-changed", "manual-export"]
    df = spark.createDataFrame([(b"ok \xff\xc3", 1), (None, 2)], "b binary, i int")
    assert [tuple(r) for r in df.select(T.coerce(F.col("b"), "bytes"), T.coerce(F.struct("i"), "record"), T.coerce(F.col("i"), "function")).collect()] == [("ok ", '{"i":1}', "1"), (None, '{"i":2}', "2")]
    ids = {r[0] for r in spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), ("aa", "")], "x string, y string").select(T.stable_id(F.col("x"), F.col("y"))).collect()}
    assert len(ids) == 4 and all(len(i) == 36 for i in ids)


def test_betweenness_runs_over_classes_of_twins(spark):
    """Sixty nodes with the same neighbours are one class: the rounds hold a few rows and not one for each source and node."""
    rows = [(a, f"n{b}") for a in range(60) for b in range(4)] + [(60, "n0"), (61, "n0"), (62, "n1"), (62, "m"), (63, "m")]
    df = spark.createDataFrame(rows, "l long, r string")
    both = df.selectExpr("inline(array(struct(concat('l:', l) AS v, concat('r:', r) AS w), struct(concat('r:', r) AS v, concat('l:', l) AS w)))")
    kinds = {r.v: r.c for r in graph.twins(both).collect()}
    assert len({kinds[f"l:{a}"] for a in range(60)}) == 1 and kinds["l:60"] == kinds["l:61"] and kinds["r:n2"] == kinds["r:n3"] and len(set(kinds.values())) == 8
    want = paths_through([(f"l:{a}", f"r:{b}") for a, b in rows])
    got = {r.node: r.score for r in graph.betweenness(df, "l", "r").collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)


def test_fingerprints_shuffle_a_row_for_each_text(spark):
    """Grams are counted where their text is: the plan deals out by the key only, once."""
    texts = [(i, x) for i, x in enumerate(["", None, "ab", "aaaaaaaaaa", "abcabcabc abcabc", "The cat sat on the mat. " * 9, "\u00e4 b-c_d " * 5])]
    df = spark.createDataFrame(texts, "k long, t string")
    out = simhash.fingerprint(df, "k", "t")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in df.select("k", simhash.fingerprint_udf("t")).collect()}
