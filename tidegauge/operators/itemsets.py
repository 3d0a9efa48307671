"""Co-occurrence of items in baskets, frequent itemsets per class, and contrasts between classes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegauge.functions import url as U
from tidegauge.operators import bitmaps
from tidegauge.plans.checkpoints import cut
from tidegauge.plans.views import select, view
from tidegauge.registry import query, table

EPS = 1e-6


def levels(baskets: DataFrame, basket: str, item: str, least: int, most: int) -> list[DataFrame]:
    """Itemsets (items, n) of 1, 2, ... ``most`` items in at least ``least`` baskets, level by level (Apriori).

    Items that are rare alone go first; each level joins the baskets' itemsets of the level before with the
    frequent ones, so a basket only makes candidates whose prefix is frequent. Levels are materialised, so each is made once.
    """
    rows = baskets.select(basket, item).distinct()
    single = cut(rows.groupBy(item).agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    rows = cut(rows.join(single.select(item), item, "left_semi")) if most > 1 else rows
    level = rows.select(basket, F.array(item).alias("items"))
    out = [single.select(F.array(item).alias("items"), "n")]
    for k in range(2, most + 1):
        longer = level.join(rows, basket).filter(F.col(item) > F.element_at("items", -1)).select(basket, F.array_append("items", F.col(item)).alias("items"))
        out.append(cut(longer.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least)))
        if k < most:
            level = cut(longer.join(out[-1].select("items"), "items", "left_semi"))
    return out


def frequent(baskets: DataFrame, basket: str, item: str, least: int, size: int) -> DataFrame:
    """Itemsets of exactly ``size`` items in at least ``least`` baskets, as (items, n)."""
    return levels(baskets, basket, item, least, size)[-1]


def inverted_support(baskets: DataFrame, basket: str, item: str, sets: DataFrame) -> DataFrame:
    """Baskets that hold all items of each listed set (items array), by intersecting the items' basket lists."""
    s = sets.select("items").distinct()
    hits = s.select("items", F.explode("items").alias(item)).join(baskets.select(basket, item).distinct(), item)
    whole = hits.groupBy("items", basket).agg(F.count("*").alias("k")).filter(F.col("k") == F.size("items"))
    return s.join(whole.groupBy("items").agg(F.count("*").alias("n")), "items", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fp_growth(baskets: DataFrame, basket: str, item: str, min_support: float, max_len: int) -> DataFrame:
    """Frequent itemsets (sorted items, n) of at most ``max_len`` items, on bitmaps (:mod:`tidegauge.operators.bitmaps`)."""
    n = baskets.select(basket).distinct().count()
    return bitmaps.eclat(baskets, basket, item, max(1, int(np.ceil(min_support * n - 1e-9))), max_len)


#: Tables that are likelier by less than ``TIE`` (of logarithms) count as equal; those less likely by more than ``FAR`` add nothing that a double holds.
TIE, FAR = 1e-7, 60.0


def _first(lo: int, hi: int, holds: Callable[[int], bool]) -> int:
    """The first of lo, ..., hi - 1 from which on a condition holds, else hi."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid + 1, hi)
    return lo


def fisher_p(p: int, q: int, r: int, s: int) -> float:
    """Two-sided Fisher exact p of [[p, q], [r, s]].

    The probabilities rise to the mode and fall from there, so on either side the tables that count and that aren't
    negligible lie together: their ends are searched for, and only what is between them is added up.
    """
    n1, n2, m = p + q, r + s, p + r
    if n1 == 0 or n2 == 0 or m == 0 or m == n1 + n2:
        return 1.0
    lo, hi = max(0, m - n2), min(m, n1)
    mode = min(max((m + 1) * (n1 + 1) // (n1 + n2 + 2), lo), hi)
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    whole = choose(n1 + n2, m)
    log_p = lambda x: choose(n1, x) + choose(n2, m - x) - whole
    own = log_p(p)

    def total(x: int, y: int) -> float:
        """The probabilities of x, ..., y - 1, by the ratios of neighbours."""
        if x >= y:
            return 0.0
        k = np.arange(x, y - 1, dtype=np.float64)
        steps = np.log((n1 - k) * (m - k)) - np.log((k + 1) * (n2 - m + k + 1))
        return float(np.exp(log_p(x) + np.concatenate(([0.0], np.cumsum(steps)))).sum())

    left = _first(lo, mode + 1, lambda x: log_p(x) > own + TIE)
    right = _first(mode + 1, hi + 1, lambda x: log_p(x) <= own + TIE)
    far_left = _first(lo, left, lambda x: log_p(x) >= own - FAR)
    far_right = _first(right, hi + 1, lambda x: log_p(x) < own - FAR)
    return min(1.0, total(far_left, left) + total(right, far_right))


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of each table [[a, b], [c, d]]: the probabilities of all tables no likelier than it."""
    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


def contrast(pos: DataFrame, neg: DataFrame, basket: str, item: str, min_support: float, max_len: int = 4) -> DataFrame:
    """Itemsets frequent in either class with counts, supports, lift and Fisher's p in both, highest lift first."""
    n_pos, n_neg = pos.select(basket).distinct().count(), neg.select(basket).distinct().count()
    a, b = (fp_growth(x, basket, item, min_support, max_len).select("items") for x in (pos, neg))
    sets = a.union(b).distinct()
    count = lambda x, total, n: bitmaps.supports(bitmaps.prepared(x, basket, item), sets, bitmaps.ranges_of(total)).withColumnRenamed("n", n)
    both = count(pos, n_pos, "count_pos").join(count(neg, n_neg, "count_neg"), "items")
    sp, sn = F.col("count_pos") / float(max(n_pos, 1)), F.col("count_neg") / float(max(n_neg, 1))
    lift = (sp + EPS) / (sn + EPS)
    out = both.select(
        F.array_join(F.transform("items", lambda x: F.concat(F.lit("has_"), x)), " & ").alias("itemset"),
        F.size("items").cast("bigint").alias("length"),
        sp.alias("support_pos"),
        sn.alias("support_neg"),
        "count_pos",
        "count_neg",
        lift.alias("lift_ratio"),
        F.log2(lift).alias("log2_lift"),
        fisher("count_pos", n_pos - F.col("count_pos"), "count_neg", n_neg - F.col("count_neg")).alias("p_value"),
    )
    return out.orderBy(F.desc("lift_ratio"), "length", "itemset")


def lookahead_rule(params: Column) -> Column:
    """Filter rule for query keys: a plain pattern for one key, look-aheads in any order for more, empty for none."""
    esc = F.transform(params, lambda p: F.regexp_replace(p, r"([^A-Za-z0-9_])", r"\\$1"))
    many = F.concat(F.lit(r"/[\?&]"), F.array_join(F.transform(esc, lambda p: F.concat(F.lit(r"(?=[^#]*\b"), p, F.lit("=)"))), ""), F.lit("[^#]*/"))
    return F.when(F.size(params) == 0, "").when(F.size(params) == 1, F.concat(F.lit(r"/[\?&]"), esc[0], F.lit("=/"))).otherwise(many)


def rules(table_: DataFrame, min_lift: float = 2.0, max_params: int = 4) -> DataFrame:
    """(rule, lift_ratio) of the contrast rows with the lift, each rule once with its highest lift, highest first."""
    params = F.array_distinct(F.filter(F.transform(F.split("itemset", "&"), lambda p: F.regexp_extract(F.trim(p), "^has_(.+)$", 1)), lambda p: p != ""))
    r = table_.filter(F.col("lift_ratio") >= min_lift).select(params.alias("p"), "lift_ratio").filter(F.size("p").between(1, max_params))
    return r.groupBy(lookahead_rule(F.col("p")).alias("rule")).agg(F.max("lift_ratio").alias("lift_ratio")).orderBy(F.desc("lift_ratio"), "rule")


def segment_lift(pos: DataFrame, neg: DataFrame, url: str, min_neg: int = 5, top: int | None = None) -> DataFrame:
    """Path segments of both classes by their lift (shares of the classes' URLs); segments rarer than ``min_neg`` in the negatives are left out."""
    count = lambda x, n: x.select(F.explode(U.path_segments(F.col(url))).alias("segment")).groupBy("segment").agg(F.count("*").alias(n))
    n_pos, n_neg = pos.count(), neg.count()
    both = count(pos, "n_pos").join(count(neg, "n_neg"), "segment").filter((F.col("n_pos") > 0) & (F.col("n_neg") >= min_neg))
    out = both.withColumn("lift", F.round((F.col("n_pos") / float(max(n_pos, 1))) / (F.col("n_neg") / float(max(n_neg, 1))), 6)).orderBy(F.desc("lift"), F.desc("n_pos"), "segment")
    return out.limit(top) if top else out


def features(df: DataFrame, keys: Column, names: list[str], prefix: str) -> DataFrame:
    """0/1 columns for the presence of each name among the keys; names are made safe for column names."""
    safe = lambda n: prefix + "".join(c if c.isalnum() or c == "_" else "_" for c in n.strip("/"))
    return df.select("*", *(F.array_contains(keys, n).cast("int").alias(safe(n)) for n in names))


@query("pair_support", "SELECT [a.cookie, b.cookie] AS items, count(*) AS n FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie GROUP BY ALL HAVING n >= 2")
def _(s, d):
    return frequent(view(s, d, "bk"), "cluster_id", "cookie", 2, 2)


_TRIPLES = "SELECT a.cookie AS x, b.cookie AS y, c.cookie AS z, count(*) AS n FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie JOIN bk c ON c.cluster_id = b.cluster_id AND b.cookie < c.cookie GROUP BY ALL"


@query("triple_support", f"SELECT [x, y, z] AS items, n FROM ({_TRIPLES}) t WHERE n >= 40")
def _(s, d):
    return frequent(view(s, d, "bk"), "cluster_id", "cookie", 40, 3)


@query("quad_support", "SELECT [a.cookie, b.cookie, c.cookie, e.cookie] AS items, count(*) AS n FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie JOIN bk c ON c.cluster_id = b.cluster_id AND b.cookie < c.cookie JOIN bk e ON e.cluster_id = c.cluster_id AND c.cookie < e.cookie GROUP BY ALL HAVING n >= 12")
def _(s, d):
    return frequent(view(s, d, "bk"), "cluster_id", "cookie", 12, 4)


@query("join_semi_support", "WITH g AS (SELECT cookie FROM bk GROUP BY cookie HAVING count(*) >= 2250) SELECT a.cookie AS a, b.cookie AS b, count(*) AS n FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie WHERE a.cookie IN (FROM g) AND b.cookie IN (FROM g) GROUP BY ALL")
def _(s, d):
    b = view(s, d, "bk")
    good = b.groupBy("cookie").agg(F.count("*").alias("n")).filter("n >= 2250").select("cookie")
    kept = b.join(good, "cookie", "left_semi")
    return kept.withColumnRenamed("cookie", "a").join(kept.withColumnRenamed("cookie", "b"), "cluster_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("join_self_prefix", f"WITH t AS ({_TRIPLES}), g AS (SELECT * FROM t WHERE n >= 45) SELECT p.x, p.y, p.z AS z1, q.z AS z2 FROM g p JOIN g q ON p.x = q.x AND p.y = q.y AND p.z < q.z")
def _(s, d):
    g = frequent(view(s, d, "bk"), "cluster_id", "cookie", 45, 3).select(F.col("items")[0].alias("x"), F.col("items")[1].alias("y"), F.col("items")[2].alias("z"))
    return g.withColumnRenamed("z", "z1").join(g.withColumnRenamed("z", "z2"), ["x", "y"]).filter("z1 < z2")


@query("join_inverted_index_k", "SELECT [x, y, z] AS items, n FROM (" + _TRIPLES + ") t WHERE x = 'Brand#11' AND y = 'Brand#22'")
def _(s, d):
    b = view(s, d, "bk")
    third = b.select("cookie").distinct().filter("cookie > 'Brand#22'").select(F.array(F.lit("Brand#11"), F.lit("Brand#22"), F.col("cookie")).alias("items"))
    return inverted_support(b, "cluster_id", "cookie", third).filter("n > 0")


@query("join_in_unnest", "SELECT p.a, p.b, count(*) AS n FROM (SELECT list(cookie) AS l FROM bk GROUP BY cluster_id) x, (VALUES ('Brand#11', 'Brand#12'), ('Brand#33', 'Brand#55')) p(a, b) WHERE list_contains(l, p.a) AND list_contains(l, p.b) GROUP BY ALL")
def _(s, d):
    pairs = s.createDataFrame([(["Brand#11", "Brand#12"],), (["Brand#33", "Brand#55"],)], "items array<string>")
    return inverted_support(view(s, d, "bk"), "cluster_id", "cookie", pairs).filter("n > 0").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n")


@query("fp_growth", "SELECT [cookie] AS items, count(*) AS n FROM bk GROUP BY cookie UNION ALL SELECT [a.cookie, b.cookie], count(*) FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie GROUP BY a.cookie, b.cookie HAVING count(*) >= ceil((SELECT count(DISTINCT cluster_id) FROM bk) * 0.02)")
def _(s, d):
    return fp_growth(view(s, d, "bk"), "cluster_id", "cookie", 0.02, 2)


_SETS = " UNION ALL ".join(
    f"SELECT [{', '.join(x + '.cookie' for x in names)}] AS items, count(*) AS n FROM bk a {' '.join(f'JOIN bk {y} ON {x}.cluster_id = {y}.cluster_id AND {x}.cookie < {y}.cookie' for x, y in zip(names, names[1:], strict=False))} GROUP BY ALL" for names in ("a", "ab", "abc", "abce")
)


@query("fp_growth_four", f"SELECT * FROM ({_SETS}) x WHERE n >= ceil((SELECT count(DISTINCT cluster_id) FROM bk) * 0.001)")
def _(s, d):
    return fp_growth(view(s, d, "bk"), "cluster_id", "cookie", 0.001, 4)


# The queries named _deep are the same at the reference's depth; SQL would have to spell out every level.
DEEP = 3


@query("fp_growth_deep")
def _(s, d):
    return fp_growth(view(s, d, "bk"), "cluster_id", "cookie", 0.02, DEEP)


def _classes(s, d):
    b = view(s, d, "bk").join(table(s, d, "orders").select(F.col("o_orderkey").alias("cluster_id"), "o_orderstatus"), "cluster_id")
    return b.filter("o_orderstatus = 'F'").drop("o_orderstatus"), b.filter("o_orderstatus <> 'F'").drop("o_orderstatus")


_CLASS = "c AS (SELECT bk.cluster_id, cookie, o_orderstatus = 'F' AS p FROM bk JOIN orders ON o_orderkey = bk.cluster_id), t AS (SELECT count(DISTINCT cluster_id) FILTER (p) AS np, count(DISTINCT cluster_id) FILTER (NOT p) AS nn FROM c)"


@query("set_itemset_union", f"WITH {_CLASS} SELECT cookie FROM c, t GROUP BY cookie, np, nn HAVING count(*) FILTER (p) >= ceil(np * 0.14) OR count(*) FILTER (NOT p) >= ceil(nn * 0.14)")
def _(s, d):
    pos, neg = _classes(s, d)
    a, b = (fp_growth(x, "cluster_id", "cookie", 0.14, 1).select(F.col("items")[0].alias("cookie")) for x in (pos, neg))
    return a.join(b, "cookie", "full_outer")


@query("fp_support_both", f"WITH {_CLASS} SELECT cookie, count(*) FILTER (p) AS count_pos, count(*) FILTER (NOT p) AS count_neg FROM c GROUP BY cookie")
def _(s, d):
    pos, neg = _classes(s, d)
    sets = pos.union(neg).select(F.array("cookie").alias("items")).distinct()
    a = inverted_support(pos, "cluster_id", "cookie", sets).withColumnRenamed("n", "count_pos")
    return a.join(inverted_support(neg, "cluster_id", "cookie", sets).withColumnRenamed("n", "count_neg"), "items").select(F.col("items")[0].alias("cookie"), "count_pos", "count_neg")


_LP = "lgamma(np + 1) - lgamma(x + 1) - lgamma(np - x + 1) + lgamma(nn + 1) - lgamma(a + b - x + 1) - lgamma(nn - a - b + x + 1) - lgamma(np + nn + 1) + lgamma(a + b + 1) + lgamma(np + nn - a - b + 1)"
_CONTRAST = f"""WITH {_CLASS}, k AS (SELECT cookie, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM c GROUP BY cookie),
    lp AS (SELECT cookie, a, b, np, nn, x, {_LP} AS lp FROM (SELECT *, unnest(range(greatest(0, a + b - nn), least(a + b, np) + 1)) AS x FROM k, t) y)"""
_P = "round(least(1, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6)"


@query("st_fisher_exact", f"{_CONTRAST} SELECT cookie, {_P} AS p FROM (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY cookie) AS own FROM lp) z GROUP BY cookie")
def _(s, d):
    return _contrast(s, d).select(F.substring("itemset", 5, 100).alias("cookie"), F.round("p_value", 6).alias("p"))


def _contrast(s, d, max_len=1):
    pos, neg = _classes(s, d)
    return contrast(pos, neg, "cluster_id", "cookie", 0.0001, max_len)


@query("fp_contrast_table_deep")
def _(s, d):
    return _contrast(s, d, DEEP)


@query("fp_significant_count_deep")
def _(s, d):
    return _contrast(s, d, DEEP).filter((F.col("p_value") < 0.05) & (F.abs("log2_lift") > 0.05)).groupBy("length").agg(F.count("*").alias("n"))


@query("fp_contrast_table", f"WITH {_CLASS}, k AS (SELECT cookie, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM c GROUP BY cookie) SELECT 'has_' || cookie AS itemset, 1::BIGINT AS length, a AS count_pos, b AS count_neg, round(log2((a / np + 1e-6) / (b / nn + 1e-6)), 6) AS log2_lift FROM k, t")
def _(s, d):
    return _contrast(s, d).select("itemset", "length", "count_pos", "count_neg", F.round("log2_lift", 6).alias("log2_lift"))


@query("fp_significant_count", f"{_CONTRAST} SELECT count(*) AS n FROM (SELECT cookie, {_P} AS p, any_value(abs(log2((a / np + 1e-6) / (b / nn + 1e-6)))) AS l FROM (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY cookie) AS own FROM lp) z GROUP BY cookie) w WHERE p < 0.05 AND l > 0.05")
def _(s, d):
    return _contrast(s, d).filter((F.col("p_value") < 0.05) & (F.abs("log2_lift") > 0.05)).agg(F.count("*").alias("n"))


_KEYS = r"list_distinct(list_transform(list_filter(string_split(regexp_extract(regexp_extract(url, '^[^#]*'), '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: split_part(p, '=', 1)))"


@query("qk_topk", f"SELECT key, count(*) AS n FROM (SELECT unnest({_KEYS}) AS key FROM lab WHERE positive) x GROUP BY key ORDER BY n DESC, key LIMIT 100")
def _(s, d):
    return top_keys(view(s, d, "lab"), "url", "positive", "positive", 100)


def top_keys(df: DataFrame, url: str, flag: str, source: str = "both", k: int = 100) -> DataFrame:
    """The most frequent query keys of the positive, negative or all URLs; ties by key."""
    rows = {"positive": df.filter(F.col(flag)), "negative": df.filter(~F.col(flag)), "both": df}[source]
    return rows.select(F.explode(U.query_keys(F.col(url))).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)


@query("qk_features", f"SELECT page_id, list_contains(k, 'page')::INT AS has_page, list_contains(k, 'ref')::INT AS has_ref, list_contains(k, 'utm_source')::INT AS has_utm_source FROM (SELECT page_id, {_KEYS} AS k FROM pages) x")
def _(s, d):
    p = table(s, d, "pages").select("page_id", U.query_keys(F.col("url")).alias("k"))
    return features(p, F.col("k"), ["page", "ref", "utm_source"], "has_").drop("k")


@query("ps_features", r"SELECT page_id, regexp_matches(url, '^[^?#]*://[^/?#]*/(.*/)?en(/|[?#]|$)')::INT AS path_en, regexp_matches(url, '^[^?#]*://[^/?#]*/(.*/)?de(/|[?#]|$)')::INT AS path_de FROM pages")
def _(s, d):
    p = table(s, d, "pages").select("page_id", U.path_segments(F.col("url")).alias("k"))
    return features(p, F.col("k"), ["/en", "/de"], "path_").drop("k")


_SEG = r"list_transform(list_filter(string_split(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: '/' || x)"
_LIFT = f"""WITH g AS (SELECT positive, unnest(CASE WHEN len(s) > 0 THEN list_append(s, s[1]) ELSE s END) AS segment FROM (SELECT positive, {_SEG} AS s FROM lab) x),
    t AS (SELECT count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM lab)
    SELECT segment, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg, round((count(*) FILTER (positive) / any_value(np)) / (count(*) FILTER (NOT positive) / any_value(nn)), 6)::DOUBLE AS lift FROM g, t GROUP BY segment HAVING n_pos > 0 AND n_neg >= 5"""


@query("ps_lift_rank", _LIFT)
def _(s, d):
    l = view(s, d, "lab")
    return segment_lift(l.filter("positive"), l.filter(~F.col("positive")), "url")


@query("topk_lift", _LIFT + " ORDER BY lift DESC, n_pos DESC, segment LIMIT 2")
def _(s, d):
    l = view(s, d, "lab")
    return segment_lift(l.filter("positive"), l.filter(~F.col("positive")), "url", top=2)


# Contrast rows that the parts give: one to three keys with characters that a pattern must escape, and one row that holds no key.
_ITEMSETS = "SELECT CASE p_partkey % 4 WHEN 0 THEN concat('has_', p_brand) WHEN 1 THEN concat('has_', p_brand, ' & has_b-', p_size) WHEN 2 THEN concat('has_', p_brand, ' & has_c.', p_size % 5, ' & has_x') ELSE 'other' END AS itemset, p_size / 10.0 AS lift_ratio FROM part"
_AHEAD = r"list_transform(list_transform(list_filter(string_split(itemset, ' & '), lambda x: starts_with(x, 'has_')), lambda x: x[5:]), lambda x: regexp_replace(x, '([^A-Za-z0-9_])', '\\\1', 'g'))"


@query(
    "rg_rules",
    rf"""SELECT CASE WHEN len(p) = 0 THEN '' WHEN len(p) = 1 THEN '/[\?&]' || p[1] || '=/' ELSE '/[\?&]' || array_to_string(list_transform(p, lambda x: '(?=[^#]*\b' || x || '=)'), '') || '[^#]*/' END AS rule, max(lift_ratio)::DOUBLE AS lift_ratio
    FROM (SELECT {_AHEAD} AS p, lift_ratio FROM ({_ITEMSETS}) i) x WHERE len(p) > 0 AND lift_ratio >= 2 GROUP BY ALL""",
)
def _(s, d):
    return rules(select(s, d, _ITEMSETS).withColumn("lift_ratio", F.col("lift_ratio").cast("double")))


@query("gr_edges_distinct", "SELECT DISTINCT cookie, cluster_id FROM bk")
def _(s, d):
    return view(s, d, "bk").select("cookie", "cluster_id").distinct()
