"""Rule matching by the automaton against every rule on every URL."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.operators import blocking as B
from tidegauge.operators import matching as M


@pytest.mark.parametrize(
    ("regex", "want"),
    [
        ("abc", ["abc"]),
        (r"a\.b[0-9]+wxyz", ["wxyz"]),
        ("ab+c", ["ab"]),
        ("abc?d", ["ab"]),
        ("abc{0,2}", ["ab"]),
        ("foo|ba.r", ["ba", "foo"]),
        ("foo|.", []),
        ("(foo|bar)baz", ["baz"]),
        (r"[\]x(]long(?=[^#]*\bq=)", ["long"]),
        ("(?i)AbC", ["abc"]),
        (r"\x41bc", []),
        (r"\d\w.", []),
        ("^http://a$", ["http://a"]),
        ("a(b(c)d)*ef", ["ef"]),
        ("x*?yz", ["yz"]),
        ("", []),
    ],
)
def test_literals(regex, want):
    assert M.literals(regex) == want


PARTS = ["ab", "c", "d?", "e+", "f*", "(gh|i)", "[jk]", "[^l]", ".", r"\d", r"\.", "m{1,2}", "(?:no)?", "|", "P", "/"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=6), st.text("abcdefghijklmnoP./1", max_size=14))
def test_matches_hold_a_literal(parts, text):
    regex = "".join(parts)
    found = M.literals(regex)
    if found and re.search(regex, text):
        assert any(x in M.lowered(text) for x in found)


def plain(urls, lines):
    """Rule by rule and URL by URL."""
    parsed = [(r, re.compile(r.regex, re.ASCII)) for r in map(B.parse_rule, lines) if r.kind in ("block", "allow") and not r.options and not r.domains]
    out = {}
    for u in urls:
        met = [r for r, p in parsed if p.search(u)]
        blocking = [r.raw for r in met if r.kind == "block"]
        if met:
            out[u] = None if any(r.kind == "allow" for r in met) else min(blocking)
    return out


def generated(urls, n, seed=1):
    """Rules of all forms from hosts, paths and queries of the URLs, most of them changed so that they match little."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    out = []
    while len(out) < n:
        host, _, path = rng.choice(urls).partition("://")[2].partition("/")
        host = host if rng.random() < 0.02 else f"{word(rng.randint(2, 12))}.{host.rpartition('.')[2]}"
        seg = rng.choice(re.split("[/?&]", path) or ["x"])
        seg = seg if rng.random() < 0.02 else word(rng.randint(1, 10)) + seg
        out += [rng.choice(["||{h}^", "@@||{h}^", "||{h}/{s}", "/{s}/*", "|https://{h}/", "{s}|", "&{s}=", "-{s}.", "/{s}\\d+[a-z]/", "*{h}*{s}^", "{s}$script", "||{h}^$domain=a.com", "! {s}", "{h}##.ad"]).format(h=host, s=seg)]
    return out


def test_thirty_thousand_rules(spark, monkeypatch):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    urls += ["", "http://x", "HTTP://WWW.EXAMPLE.NET/É?q", "a" * 5000 + ".com/"]
    lines = generated(urls, 30_000) + ["/\\d{4}/", "/[0-9]+.$/"]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    rules = B.parse_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    want = plain(urls, lines)
    assert len(want) > 50 and None in want.values()
    for size in (M.SHARD_RULES, 7_000):  # one automaton, and several
        monkeypatch.setattr(M, "SHARD_RULES", size)
        assert {r.url: r.rule for r in B.match_rules(df, rules).collect()} == want


def test_many_rules_without_any_literal(spark, monkeypatch):
    """More than fit an array, and than are sent out at once."""
    monkeypatch.setattr(M, "LOOSE_RULES", 40)
    monkeypatch.setattr(M, "SHARD_RULES", 100)
    lines = [f"/[{a}][{b}][{c}]/" for a in "abcdefgh" for b in "abcdefgh" for c in "xyz123"]
    urls = ["abx", "hh3", "aaz/ab1", "zzz", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = B.parse_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.url: r.rule for r in B.match_rules(df, rules).collect()} == plain(urls, lines)


def test_no_rules_or_urls(spark):
    df = spark.createDataFrame([("http://x",)], "url string")
    none = B.parse_rules(spark.createDataFrame([("! c",)], "value string"))
    assert B.match_rules(df, none).collect() == []
    assert B.match_rules(df.limit(0), B.parse_rules(spark.createDataFrame([("x",)], "value string"))).collect() == []
