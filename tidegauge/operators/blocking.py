"""Cookie-identifier heuristic, filter rules, URL classification and evaluation of lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.operators.identifiers import alike, lengths_differ, may_be_alike, may_exceed
from tidegauge.operators.matching import hits, literals
from tidegauge.operators.overview import r6
from tidegauge.plans.checkpoints import cut
from tidegauge.plans.views import select, view
from tidegauge.registry import query, table

# ---- identifier heuristic

SIMILARITY = 0.6
#: Values of a block whose pairs one group compares with another block.
PAIR_BLOCK = 500
#: Share of the longer value by which lengths may differ.
LENGTHS = 0.25
#: First values of a cookie on a site that meet all its others, and the size of the others' blocks: a few, then more where those pass.
HEADS = ((8, 8 * PAIR_BLOCK), (PAIR_BLOCK, PAIR_BLOCK))
#: Values that are compared one by one, since bit vectors pay for more only.
FEW = 12


def _values(cookies: DataFrame, name: str, site: str, value: str, profile: str) -> DataFrame:
    """(name, site, p, v) of the named cookies on sites that more than one profile saw; a null value counts as empty."""
    none = F.lit("") if cookies.schema[profile].dataType.simpleString() == "string" else F.lit(-(1 << 31)).cast(cookies.schema[profile].dataType)  # stands before others
    own = cookies.filter(F.col(name).isNotNull() & (F.length(name) > 0) & F.col(site).isNotNull()).select(F.col(name).alias("name"), F.col(site).alias("site"), F.coalesce(profile, none).alias("p"), F.coalesce(value, F.lit("")).alias("v"))
    seen = own.groupBy("site").agg(F.countDistinct("p").alias("_k")).filter("_k > 1").select("site")
    return own.join(seen, "site", "left_semi")


def _block_pairs(values: DataFrame, which: str) -> DataFrame:
    """The values (name, site, p, v, _b blocks) of every two blocks (_i, _j) that meet: a block with itself (``own``), or two different ones (``cross``)."""
    held = values.withColumn("_own", F.pmod(F.xxhash64("p", "v"), F.col("_b")).cast("int"))
    if which == "own":
        return held.select("name", "site", "p", "v", F.col("_own").alias("_i"), F.col("_own").alias("_j"), F.lit(True).alias("_left"))
    others = F.filter(F.sequence(F.lit(0), F.col("_b") - 1), lambda k: k != F.col("_own"))
    met = held.select("name", "site", "p", "v", "_own", F.explode(others).alias("_o"))
    return met.select("name", "site", "p", "v", F.least("_own", "_o").alias("_i"), F.greatest("_own", "_o").alias("_j"), (F.col("_own") < F.col("_o")).alias("_left"))


def _like_pairs(left: list, right: list, within: bool, threshold: float) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of (p, v) of two blocks, or within one (sorted), that may be alike; the smaller one first."""
    for i, j in may_be_alike([v for _, v in left], [v for _, v in right], threshold) if left and right else ():
        if not within or i < j:
            yield (left[i], right[j]) if left[i] <= right[j] else (right[j], left[i])


def hold_id(cookies: DataFrame, name: str = "name", site: str = "top_level_etld", value: str = "value", profile: str = "browser_id", threshold: float = SIMILARITY) -> DataFrame:
    """(name, site, n, hold_id): whether all values of a cookie on a site differ between visits like identifiers do.

    Sites seen by one profile only are left out; a cookie with one record holds no identifier. Equal values
    fail the similarity test, so a cookie with a repeated value is decided before any pair is made, and pairs
    are made between distinct values only. The similarity depends on the order of its arguments; the smaller
    (profile, value) comes first. Values are dealt into blocks of ``PAIR_BLOCK``; first each block is compared with itself,
    which takes time in proportion and decides most cookies with like values, then the others' blocks with one another.
    A bound by common subsequences goes before the matcher (:mod:`tidegauge.operators.identifiers`).
    """
    own = _values(cookies, name, site, value, profile)
    # all lengths within a quarter of each other: the shortest against the longest decides
    stats = own.groupBy("name", "site").agg(F.count("*").alias("n"), F.countDistinct("v").alias("k"), F.min_by("v", F.length("v")).alias("short"), F.max_by("v", F.length("v")).alias("long"))
    stats = cut(stats.select("name", "site", "n", ((F.col("n") > 1) & (F.col("n") == F.col("k")) & T.length_ok(F.col("short"), F.col("long"))).alias("open")))
    blocks = stats.filter("open").select("name", "site", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("_b"))
    live = cut(own.join(blocks, ["name", "site"]))

    def decide(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            found = []
            for within, rows in zip(batch["_within"], batch["_rows"], strict=True):
                pdf = sorted((r["p"], r["v"], r["_left"]) for r in rows)
                left, right = [r[:2] for r in pdf if r[2]], [r[:2] for r in pdf if within or not r[2]]
                if len(pdf) <= FEW:
                    pairs = ((x, y) if x <= y else (y, x) for i, x in enumerate(left) for y in (right[i + 1 :] if within else right))
                    found.append(any(may_exceed(x[1], y[1], threshold) and alike(x[1], y[1], threshold) for x, y in pairs))
                else:
                    found.append(any(alike(x[1], y[1], threshold) for x, y in _like_pairs(left, right, within, threshold)))
            yield batch.loc[found, ["name", "site"]]

    kind = live.schema["site"].dataType.simpleString()

    def met(df: DataFrame, which: str) -> DataFrame:
        # two blocks at most are in a list
        lists = _block_pairs(df, which).groupBy("name", "site", "_i", "_j").agg(F.collect_list(F.struct("p", "v", "_left")).alias("_rows"))
        lists = lists.filter(F.size("_rows") > 1).select("name", "site", (F.col("_i") == F.col("_j")).alias("_within"), "_rows")
        return cut(lists.mapInPandas(decide, f"name string, site {kind}").distinct())

    near = met(live, "own")
    left = live.filter("_b > 1").join(near, ["name", "site"], "left_anti")
    bad = near.unionByName(met(left, "cross")).withColumn("bad", F.lit(True))
    out = stats.join(bad, ["name", "site"], "left").select(F.col("name").alias(name), F.col("site").alias(site), "n", (F.col("open") & F.col("bad").isNull()).alias("hold_id"))
    return out


def hold_id_faithful(cookies: DataFrame, name: str = "name", site: str = "top_level_etld", value: str = "value", profile: str = "browser_id", threshold: float = SIMILARITY) -> DataFrame:
    """(name, site, hold_id, unique_ok, similarity_ok, passed_checkin): which test the first pair fails that fails any.

    Pairs are ordered by their (profile, value); a pair whose lengths differ fails that test only. A pair of one of the first
    values stands before all pairs of later ones, so a few first values meet all others, then more of them where none of those
    failed (``HEADS``). What is open after that is compared in full: every two blocks give their least failing pair, and the least of these decides.
    """
    own = _values(cookies, name, site, value, profile)
    distinct = own.groupBy("name", "site", "p", "v").agg(F.count("*").alias("_c"))
    stats = cut(own.groupBy("name", "site").agg(F.count("*").alias("n"), F.countDistinct("p", "v").alias("_k")))
    live = cut(distinct.join(stats.filter("n > 1").select("name", "site", F.ceil(F.col("_k") / PAIR_BLOCK).cast("int").alias("_b")), ["name", "site"]))
    twice = live.filter("_c > 1").select("name", "site", F.struct(F.col("p").alias("p1"), F.col("v").alias("v1"), F.col("p").alias("p2"), F.col("v").alias("v2"), F.lit(False).alias("lengths")).alias("first"))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["p"], pdf["v"], pdf["_left"], strict=True), key=lambda r: r[:2])
        within = key[2] == key[3]
        left, right = [r[:2] for r in rows if r[2]], [r[:2] for r in rows if within or not r[2]]
        n, m = (np.array([len(v) for _, v in x], dtype=np.int64) for x in (left, right))
        longer = np.maximum.outer(n, m)
        differ = (longer > 0) & ((np.minimum.outer(n, m) == 0) | (np.abs(np.subtract.outer(n, m)) > LENGTHS * longer))
        if within:
            differ &= np.triu(np.ones_like(differ), 1)
        pair = lambda i, j: (left[i], right[j]) if left[i] <= right[j] else (right[j], left[i])
        least = min((pair(i, j) for i, j in zip(*np.nonzero(differ), strict=True)), default=None)
        failing, lengths = least, True
        for a, b in sorted(_like_pairs(left, right, within, threshold)):
            if failing is not None and (a, b) >= failing:
                break
            if not lengths_differ(a[1], b[1], LENGTHS) and alike(a[1], b[1], threshold):
                failing, lengths = (a, b), False
                break
        if failing is None:
            return pd.DataFrame({c: [] for c in ("name", "site", "p1", "v1", "p2", "v2", "lengths")}, dtype=object)
        (p1, v1), (p2, v2) = failing
        return pd.DataFrame({"name": [key[0]], "site": [key[1]], "p1": [p1], "v1": [v1], "p2": [p2], "v2": [v2], "lengths": [lengths]})

    types = {c: live.schema[c].dataType.simpleString() for c in ("site", "p")}
    schema = f"name string, site {types['site']}, p1 {types['p']}, v1 string, p2 {types['p']}, v2 string, lengths boolean"
    found = lambda pairs: pairs.groupBy("name", "site", "_i", "_j").applyInPandas(first, schema).select("name", "site", F.struct("p1", "v1", "p2", "v2", "lengths").alias("first"))
    least = lambda some: some.groupBy("name", "site").agg(F.min("first").alias("first"))
    order = Window.partitionBy("name", "site").orderBy("p", "v")
    open_, decided = live.drop("_c"), []
    for n, size in HEADS:
        heads = cut(open_.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r"))
        last = heads.groupBy("name", "site").agg(F.max(F.struct("p", "v")).alias("last"), (F.count("*") < n).alias("all"))
        blocks = F.ceil(F.col("_b") * PAIR_BLOCK / size).cast("int")
        own = heads.select("name", "site", "p", "v", F.lit(-1).alias("_i"), F.explode(F.sequence(F.lit(-1), blocks - 1)).alias("_j"), F.lit(True).alias("_left"))
        others = open_.join(last, ["name", "site"]).filter(F.struct("p", "v") > F.col("last"))
        others = others.select("name", "site", "p", "v", F.lit(-1).alias("_i"), F.pmod(F.xxhash64("p", "v"), blocks).cast("int").alias("_j"), F.lit(False).alias("_left"))
        met = least(found(own.unionByName(others)).unionByName(twice))
        one = F.struct(F.col("first.p1").alias("p"), F.col("first.v1").alias("v"))
        met = cut(last.join(met, ["name", "site"], "left").select("name", "site", "first", (F.col("all") | F.col("first").isNotNull() & (one <= F.col("last"))).alias("done")))
        decided.append(met.filter("done").select("name", "site", "first"))
        open_ = cut(open_.join(met.filter("not done").select("name", "site"), ["name", "site"]))
        if open_.isEmpty():
            break
    else:
        both = _block_pairs(open_, "own").unionByName(_block_pairs(open_, "cross"))
        decided.append(least(found(both).unionByName(twice.join(open_.select("name", "site").distinct(), ["name", "site"], "left_semi"))))
    least = reduce(DataFrame.unionByName, decided)
    several, failed = F.col("n") > 1, F.col("first.lengths")
    flags = [(several & failed.isNull()).alias("hold_id"), (several & ~F.coalesce(failed, F.lit(False))).alias("unique_ok"), (several & F.coalesce(failed, F.lit(True))).alias("similarity_ok"), several.alias("passed_checkin")]
    return stats.join(least, ["name", "site"], "left").select("name", F.col("site").cast("string").alias("site"), *flags)


# ---- filter rules

# The options of the filter language that are on or off.
BINARY = "script image stylesheet object xmlhttprequest object-subrequest subdocument document elemhide other background xbl ping dtd media third-party match-case collapse donottrack websocket".split()
_OPTIONS = re.compile(r",(?=~?(?:" + "|".join([*BINARY, "domain"]) + r")(?:[,=]|$))")
# What ``||`` and ``^`` mean.
LABEL_START = r"^(?:[^:/?#]+:)?(?://(?:[^/?#]*\.)?)?"
SEPARATOR = r"(?:[^\w\-.%]|$)"


@dataclass
class Rule:
    """One parsed line of a filter list."""

    raw: str
    kind: str  # comment, html, block or allow
    regex: str = ""
    options: dict[str, bool] = field(default_factory=dict)
    domains: dict[str, bool] = field(default_factory=dict)


def to_regex(pattern: str) -> str:
    """The pattern language as a regular expression: ``/.../`` is one already; ``*`` anything, ``^`` a separator or the end, ``|`` an end of the address, ``||`` the start of a domain label."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return pattern[1:-1]
    head = tail = ""
    if pattern.startswith("||"):
        head, pattern = LABEL_START, pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    body = "".join({"*": ".*", "^": SEPARATOR}.get(c, c if c.isalnum() or c in "_/:,;=&%~@!#'\"<> -" else "\\" + c) for c in pattern)
    return head + body + tail


def parse_rule(line: str) -> Rule:
    """Comments and blanks, element-hiding rules, exceptions, options and their negations, domain lists."""
    text = line.strip()
    if not text or text.startswith(("!", "[Adblock")):
        return Rule(line, "comment")
    if "##" in text or "#@#" in text:
        return Rule(line, "html")
    kind = "allow" if text.startswith("@@") else "block"
    text = text.removeprefix("@@")
    regex_rule = len(text) > 1 and text.startswith("/") and text.endswith("/")
    pattern, _, given = (text, "", "") if regex_rule else text.rpartition("$") if "$" in text else (text, "", "")
    rule = Rule(line, kind, to_regex(pattern))
    for option in _OPTIONS.split(given) if given else []:
        if option.startswith("domain="):
            rule.domains = {d.lstrip("~"): not d.startswith("~") for d in re.split(r"[|,]", option[7:]) if d}
        else:
            rule.options[option.lstrip("~")] = not option.startswith("~")
    return rule


def parse_rules(lines: DataFrame, text: str = "value", list_name: Column | None = None) -> DataFrame:
    """(list, raw, kind, regex, literals, options, domains) of the lines; comments and element-hiding rules included."""
    schema = "list string, raw string, kind string, regex string, literals array<string>, options map<string,boolean>, domains map<string,boolean>"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            parsed = [parse_rule(t or "") for t in b["raw"]]
            yield pd.DataFrame({"list": b["list"], "raw": b["raw"], "kind": [p.kind for p in parsed], "regex": [p.regex for p in parsed], "literals": [literals(p.regex.replace(LABEL_START, "^").replace(SEPARATOR, ".")) for p in parsed], "options": [p.options for p in parsed], "domains": [p.domains for p in parsed]})

    return lines.select((list_name if list_name is not None else F.lit("rules")).alias("list"), F.col(text).alias("raw")).mapInPandas(batches, schema)


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url", options: dict[str, bool] | None = None, domain: str | None = None) -> DataFrame:
    """(url, list, blocked, rule) of each distinct URL and list: an exception wins, else the first blocking rule by text.

    An automaton of the rules' literals finds the rules to try (:mod:`tidegauge.operators.matching`); any number of rules will do.
    A rule whose options aren't given is not applied. Rules of equal text are one.
    """
    given = options or {}
    active = rules.filter(F.col("kind").isin("block", "allow"))
    known = F.forall(F.map_keys("options"), lambda k: k.isin("match-case", *given))
    agree = F.forall(F.map_entries("options"), lambda e: (e["key"] == "match-case") | F.coalesce(F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(v))))[e["key"]] == e["value"], F.lit(False))) if given else F.lit(True)
    active = active.filter(known & agree & ((F.size("domains") == 0) | F.lit(domain is not None)))
    if domain is not None:
        variants = [".".join(domain.split(".")[i:]) for i in range(len(domain.split(".")))]
        verdicts = F.filter(F.array(*(F.try_element_at("domains", F.lit(x)) for x in variants)), lambda v: v.isNotNull())
        active = active.filter((F.size("domains") == 0) | F.coalesce(F.get(verdicts, F.lit(0)), ~F.exists(F.map_values("domains"), lambda v: v)))
    u = urls.select(url).distinct()
    found = hits(u, active.dropDuplicates(["list", "kind", "raw"]), url)
    g = found.groupBy(url, "list").agg(F.bool_or(F.col("kind") == "allow").alias("allowed"), F.min(F.when(F.col("kind") == "block", F.col("raw"))).alias("rule"))
    return g.select(url, "list", (~F.col("allowed") & F.col("rule").isNotNull()).alias("blocked"), F.when(~F.col("allowed"), F.col("rule")).alias("rule"))


def multi_list(urls: DataFrame, rules: DataFrame, lists: Sequence[str], url: str = "url") -> DataFrame:
    """Each distinct URL with a boolean and the rule text per list, and whether any list blocks it."""
    m = match_rules(urls, rules, url)
    agg = [e for n in lists for e in (F.coalesce(F.bool_or(F.when(F.col("list") == n, F.col("blocked"))), F.lit(False)).alias(f"{n}_blocked"), F.max(F.when(F.col("list") == n, F.col("rule"))).alias(f"{n}_rule"))]
    out = urls.select(url).distinct().join(m.groupBy(url).agg(*agg), url, "left").fillna(False)
    any_ = F.lit(False)
    for n in lists:
        any_ = any_ | F.col(f"{n}_blocked")
    return out.withColumn("is_tracker", any_)


def coverage(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """(list, blocked, pct, only): what each list blocks and what it alone blocks, in one pass."""
    yes = {n: F.coalesce(F.col(n), F.lit(False)) for n in lists}
    cols = [F.count("*").alias("total")]
    for n in lists:
        others = F.lit(False)
        for m in lists:
            others = others | yes[m] if m != n else others
        cols += [F.count_if(yes[n]).alias(f"{n}_b"), F.count_if(yes[n] & ~others).alias(f"{n}_o")]
    one = df.agg(*cols)
    rows = F.array(*(F.struct(F.lit(n).alias("list"), F.col(f"{n}_b").alias("blocked"), F.round(F.col(f"{n}_b") * 100.0 / F.col("total"), 2).alias("pct"), F.col(f"{n}_o").alias("only")) for n in lists))
    return one.select(F.inline(rows))


def overlap(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Marginals, the union of the first two as baseline, pairwise and triple intersections, and what only or also the third blocks."""
    x, y, z = (F.coalesce(F.col(n), F.lit(False)) for n in (a, b, c))
    f = F.count_if
    return df.agg(f(x).alias("a"), f(y).alias("b"), f(z).alias("c"), f(x | y).alias("baseline"), f(x & y).alias("ab"), f(x & z).alias("ac"), f(y & z).alias("bc"), f(x & y & z).alias("abc"), f(z & ~(x | y)).alias("only_c"), f((x | y) & ~z).alias("only_baseline"), f(z & (x | y)).alias("both_n"))


def confusion(df: DataFrame, label: str, flag: str) -> DataFrame:
    """Counts per label value and flag."""
    return df.groupBy(label, flag).agg(F.count("*").alias("n"))


_RULES = ["! comment", "[Adblock Plus 2.0]", "||example.net^", "@@||www.example.net^", "utm_source=", "/page=\\d/", "|http://blog.", ".html|", "spam-farm$third-party", "##.ad", "*pills*de", "@@/en/4$domain=example.com"]


def _rules(s):
    return parse_rules(s.createDataFrame([(r,) for r in _RULES], "value string"))


# Rules that the pages give, of all kinds; the texts hold no backslash, so Spark and DuckDB read them alike.
_LINES = """SELECT page_id, host, seg, leaf, url, CASE page_id % 9 WHEN 0 THEN concat('! ', url) WHEN 1 THEN concat('||', host, '^') WHEN 2 THEN concat('@@||', host, '^$third-party')
    WHEN 3 THEN concat(host, '##.ad') WHEN 4 THEN concat('/', seg, '/', leaf, '|') WHEN 5 THEN concat('|', url, '|') WHEN 6 THEN concat('||', host, '/', seg, '*', leaf)
    WHEN 7 THEN concat('@@|', url) ELSE concat('/', seg, '.[0-9]+5/') END AS value
  FROM (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, '/', 4) AS seg, split_part(url, '/', 5) AS leaf FROM pages) x"""
_KIND = "CASE page_id % 9 WHEN 0 THEN 'comment' WHEN 3 THEN 'html' WHEN 2 THEN 'allow' WHEN 7 THEN 'allow' ELSE 'block' END"


def _plain_regex(part):
    return rf"replace(replace({part}, '.', '\.'), '?', '\?')"


_LABEL, _SEP = LABEL_START, SEPARATOR
_REGEX = f"""SELECT *, {_KIND} AS kind, CASE page_id % 9 WHEN 0 THEN '' WHEN 3 THEN '' WHEN 1 THEN '{_LABEL}' || {_plain_regex("host")} || '{_SEP}' WHEN 2 THEN '{_LABEL}' || {_plain_regex("host")} || '{_SEP}'
    WHEN 4 THEN '/' || {_plain_regex("seg")} || '/' || {_plain_regex("leaf")} || '$' WHEN 5 THEN '^' || {_plain_regex("url")} || '$' WHEN 6 THEN '{_LABEL}' || {_plain_regex("host")} || '/' || {_plain_regex("seg")} || '.*' || {_plain_regex("leaf")}
    WHEN 7 THEN '^' || {_plain_regex("url")} ELSE seg || '.[0-9]+5' END AS regex FROM ({_LINES}) l"""


def _page_rules(s, d):
    return parse_rules(select(s, d, _LINES))


@query("fr_parse", f"SELECT value AS raw, {_KIND} AS kind FROM ({_LINES}) l")
def _(s, d):
    return _page_rules(s, d).select("raw", "kind")


@query("fr_to_regex", f"SELECT value AS raw, regex FROM ({_REGEX}) r")
def _(s, d):
    return _page_rules(s, d).select("raw", "regex")


_PAGE_MATCH = f"SELECT p.url, bool_or(kind = 'allow') AS allowed, min(value) FILTER (kind = 'block') AS rule FROM (SELECT DISTINCT url FROM pages) p, (SELECT DISTINCT value, kind, regex FROM ({_REGEX}) r WHERE kind IN ('allow', 'block') AND page_id % 9 <> 2) r WHERE regexp_matches(p.url, regex) GROUP BY p.url"


@query("fr_match_pages", f"SELECT url, NOT allowed AND rule IS NOT NULL AS blocked, CASE WHEN NOT allowed THEN rule END AS rule FROM ({_PAGE_MATCH}) x")
def _(s, d):
    return match_rules(table(s, d, "pages"), _page_rules(s, d)).select("url", "blocked", "rule")


_HIT = {
    "||example.net^": r"^(?:[^:/?#]+:)?(?://(?:[^/?#]*\.)?)?example\.net(?:[^\w\-.%]|$)",
    "utm_source=": "utm_source=",
    "/page=\\d/": r"page=\d",
    "|http://blog.": r"^http://blog\.",
    ".html|": r"\.html$",
    "*pills*de": ".*pills.*de",
}
_MATCH = "SELECT url, bool_or(regexp_matches(url, '^(?:[^:/?#]+:)?(?://(?:[^/?#]*\\.)?)?www\\.example\\.net(?:[^\\w\\-.%]|$)')) AS allowed, min(raw) AS rule FROM (SELECT DISTINCT url FROM pages) p, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _HIT.items()) + ") v(raw, rx) WHERE regexp_matches(url, rx) GROUP BY url"


@query("fr_match", f"SELECT url, rule FROM ({_MATCH}) x WHERE NOT allowed")
def _(s, d):
    return match_rules(table(s, d, "pages"), _rules(s)).filter("blocked").select("url", "rule")


_LISTS = [("easylist", "||example.net^"), ("easyprivacy", "utm_source="), ("easyprivacy", ".html|")]


def _two(s, d):
    rules = s.createDataFrame(_LISTS, "list string, value string")
    return multi_list(table(s, d, "pages"), parse_rules(rules, list_name=F.col("list")), ["easylist", "easyprivacy"])


_TWO = r"SELECT DISTINCT url, regexp_matches(url, '^(?:[^:/?#]+:)?(?://(?:[^/?#]*\.)?)?example\.net(?:[^\w\-.%]|$)') AS easylist_blocked, url LIKE '%utm_source=%' OR url LIKE '%.html' AS easyprivacy_blocked FROM pages"


@query("fr_two_list", _TWO)
def _(s, d):
    return _two(s, d).select("url", "easylist_blocked", "easyprivacy_blocked")


@query("fr_multi_list", f"SELECT url, easylist_blocked OR easyprivacy_blocked AS is_tracker FROM ({_TWO}) x")
def _(s, d):
    return _two(s, d).select("url", "is_tracker")


@query("ev_coverage", "SELECT 'easylist' AS list, count(*) FILTER (easylist) AS blocked, round(count(*) FILTER (easylist) * 100.0 / count(*), 2)::DOUBLE AS pct, count(*) FILTER (easylist AND NOT easyprivacy AND NOT custom) AS only FROM cls UNION ALL SELECT 'easyprivacy', count(*) FILTER (easyprivacy), round(count(*) FILTER (easyprivacy) * 100.0 / count(*), 2)::DOUBLE, count(*) FILTER (easyprivacy AND NOT easylist AND NOT custom) FROM cls UNION ALL SELECT 'custom', count(*) FILTER (custom), round(count(*) FILTER (custom) * 100.0 / count(*), 2)::DOUBLE, count(*) FILTER (custom AND NOT easylist AND NOT easyprivacy) FROM cls")
def _(s, d):
    return coverage(view(s, d, "cls"), ["easylist", "easyprivacy", "custom"])


@query(
    "ev_overlap",
    "SELECT count(*) FILTER (easylist) AS a, count(*) FILTER (easyprivacy) AS b, count(*) FILTER (custom) AS c, count(*) FILTER (easylist OR easyprivacy) AS baseline, count(*) FILTER (easylist AND easyprivacy) AS ab, count(*) FILTER (easylist AND custom) AS ac, count(*) FILTER (easyprivacy AND custom) AS bc, count(*) FILTER (easylist AND easyprivacy AND custom) AS abc, count(*) FILTER (custom AND NOT (easylist OR easyprivacy)) AS only_c, count(*) FILTER ((easylist OR easyprivacy) AND NOT custom) AS only_baseline, count(*) FILTER (custom AND (easylist OR easyprivacy)) AS both_n FROM cls",
)
def _(s, d):
    return overlap(view(s, d, "cls"), "easylist", "easyprivacy", "custom")


def label_study(df: DataFrame, label: str, flag: str) -> DataFrame:
    """(flag, yes, possible, no, total, strict_pct, lenient_pct) of hand-labelled rows: how many that the flag marks, and doesn't, are labelled so.

    ``label`` is yes, possible or no; strict counts yes only, lenient possible too. Rows without a label or flag are left out.
    """
    n = {v: F.count_if(F.col(label) == v).alias(v) for v in ("yes", "possible", "no")}
    per = df.filter(F.col(label).isin(*n) & F.col(flag).isNotNull()).groupBy(F.col(flag).alias("flag")).agg(*n.values(), F.count("*").alias("total"))
    pct = lambda x: F.round(x * 100.0 / F.col("total"), 2)
    return per.select("*", pct(F.col("yes")).alias("strict_pct"), pct(F.col("yes") + F.col("possible")).alias("lenient_pct"))


_STUDY = "SELECT CASE WHEN toxic = 1 THEN 'yes' WHEN doc_id % 3 = 0 THEN 'possible' WHEN doc_id % 41 <> 7 THEN 'no' END AS tracking, quality = 1 AS heuristic FROM labels"


@query("ev_label_table", f"SELECT tracking, heuristic, count(*) AS n FROM ({_STUDY}) x GROUP BY ALL")
def _(s, d):
    return confusion(select(s, d, _STUDY), "tracking", "heuristic")


@query(
    "ev_label_study",
    f"SELECT heuristic AS flag, count(*) FILTER (tracking = 'yes') AS yes, count(*) FILTER (tracking = 'possible') AS possible, count(*) FILTER (tracking = 'no') AS no, count(*) AS total, round(count(*) FILTER (tracking = 'yes') * 100.0 / count(*), 2)::DOUBLE AS strict_pct, round(count(*) FILTER (tracking <> 'no') * 100.0 / count(*), 2)::DOUBLE AS lenient_pct FROM ({_STUDY}) x WHERE tracking IS NOT NULL AND heuristic IS NOT NULL GROUP BY heuristic",
)
def _(s, d):
    return label_study(select(s, d, _STUDY), "tracking", "heuristic")


def _site_cookies(s, d):
    site = F.concat_ws("/", (F.col("site_id") % 40).cast("string"), "host")
    return view(s, d, "ck").select("name", site.alias("top_level_etld"), "value", "browser_id")


@query("hz_length_ok", "SELECT event_ordinal, CASE WHEN length(coalesce(value, '')) = 0 AND length(host) = 0 THEN true WHEN length(coalesce(value, '')) = 0 OR length(host) = 0 THEN false ELSE abs(length(value) - length(host)) / greatest(length(value), length(host)) <= 0.25 END AS ok FROM ck")
def _(s, d):
    return view(s, d, "ck").select("event_ordinal", T.length_ok(F.coalesce("value", F.lit("")), F.col("host")).alias("ok"))


@query("hz_similarity")
def _(s, d):
    return view(s, d, "ck").select("event_ordinal", r6(T.similarity(F.col("value"), F.col("host"))).alias("ratio"))


@query("hz_hold_id")
def _(s, d):
    return hold_id(_site_cookies(s, d))


@query("hz_hold_id_faithful")
def _(s, d):
    return hold_id_faithful(_site_cookies(s, d))
