"""Measurement statistics: counts, distincts, histograms and pivots per profile, site and page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.plans.views import view
from tidegauge.registry import query

PROFILES = ["click", "error", "purchase", "signup", "view"]


def r6(c) -> Column:
    return F.round(c, 6)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_by(df: DataFrame, group: str, *items: str, approximate: bool = False) -> DataFrame:
    """Distinct values of each item per group; ``approximate`` trades exactness for one sketch per group."""
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(group).agg(*(f(i).alias(f"n_{i}") for i in items))


def stats(df: DataFrame, col: str, population: bool = False) -> DataFrame:
    """min, max, avg and (sample) deviation in one row; nulls on an empty frame."""
    sd = F.stddev_pop(col) if population else F.stddev_samp(col)
    return df.agg(F.min(col).alias("min_n"), F.max(col).alias("max_n"), r6(F.avg(col)).alias("avg_n"), r6(sd).alias("stddev_n"))


def two_level_stats(df: DataFrame, group: str, item: str) -> DataFrame:
    """Statistics over the groups' distinct item counts."""
    return stats(df.groupBy(group).agg(F.countDistinct(item).alias("n")), "n")


def three_level_stats(df: DataFrame, outer: str, group: str, item: str) -> DataFrame:
    """Per outer key: statistics over its groups' distinct item counts."""
    per = df.groupBy(outer, group).agg(F.countDistinct(item).alias("n"))
    return per.groupBy(outer).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), r6(F.avg("n")).alias("avg_n"), r6(F.stddev_samp("n")).alias("stddev_n"))


def histogram(df: DataFrame, group: str, share: bool = False) -> DataFrame:
    """How many groups have each size; with ``share`` also their percentage of all groups (one row per size meets in the window)."""
    out = df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    return out.withColumn("pct", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))) if share else out


def share_above(df: DataFrame, group: str, least: int) -> DataFrame:
    """Percentage of groups larger than ``least``."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return sizes.agg(r6(F.count_if(F.col("size") > least) * 100.0 / F.count("*")).alias("pct"))


def profile_pivot(df: DataFrame, key: str, profile: str, profiles: Sequence[str]) -> DataFrame:
    """Rows of each key per profile, one column each, in one pass."""
    return df.groupBy(key).agg(*(F.count_if(F.col(profile) == p).alias(f"n_{p}") for p in profiles))


def presence(pivot: DataFrame, profiles: Sequence[str], mode: str) -> DataFrame:
    """Keys of a pivot present in ``all`` profiles, missing in ``any``, or present in exactly ``one``."""
    here = sum(((F.col(f"n_{p}") > 0).cast("int") for p in profiles), F.lit(0))
    return pivot.filter({"all": here == len(profiles), "any": here < len(profiles), "one": here == 1}[mode])


def both_contexts(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys seen with the flag true and with it false (unknown counts for neither)."""
    g = df.groupBy(key).agg(F.count_if(F.col(flag)).alias("fp"), F.count_if(~F.col(flag)).alias("tp"))
    return g.filter("fp > 0 and tp > 0")


def pct_of_distinct(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Share of the distinct keys that ever meet the condition."""
    per = df.groupBy(key).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("ok"))
    return per.agg(F.count_if("ok").alias("n"), r6(F.count_if("ok") * 100.0 / F.count("*")).alias("pct"))


def zero_groups(df: DataFrame, group: str, col: str) -> DataFrame:
    """Groups in which the column is null throughout."""
    return df.groupBy(group).agg(F.count(col).alias("n")).filter("n = 0")


def logical_or(df: DataFrame, flag: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_true"))


def fixed_bins(df: DataFrame, col: str, low: float, high: float, n: int, log: bool = False) -> DataFrame:
    """Counts in n equal bins of [low, high] (of the decimal logarithm of positive values with ``log``); the top edge belongs to the last bin."""
    x = F.log10(F.when(F.col(col) > 0, F.col(col))) if log else F.col(col)
    at = F.least(F.floor((x - low) * n / (high - low)).cast("int"), F.lit(n - 1))
    return df.filter(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, group: str, col: str) -> DataFrame:
    """The discrete (an element) and the interpolated median."""
    disc = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col})")
    return df.groupBy(group).agg(disc.alias("median_disc"), r6(F.percentile(col, 0.5)).alias("median"))


@query("agg_count_by", "SELECT browser_id, count(*) AS n FROM req GROUP BY browser_id")
def _(s, d):
    return count_by(view(s, d, "req"), "browser_id")


@query("agg_distinct_by", "SELECT browser_id, count(DISTINCT visit_id) AS n_visit_id, count(DISTINCT url) AS n_url FROM req GROUP BY browser_id")
def _(s, d):
    return distinct_by(view(s, d, "req"), "browser_id", "visit_id", "url")


@query(
    "agg_two_level_stats",
    """WITH p AS (SELECT browser_id, count(DISTINCT visit_id) AS n FROM req GROUP BY browser_id)
    SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS avg_n, round(stddev_samp(n), 6) AS stddev_n FROM p""",
)
def _(s, d):
    return two_level_stats(view(s, d, "req"), "browser_id", "visit_id")


@query(
    "agg_three_level",
    """WITH p AS (SELECT browser_id, site_id, count(DISTINCT visit_id) AS n FROM req GROUP BY ALL)
    SELECT browser_id, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS avg_n, round(stddev_samp(n), 6) AS stddev_n FROM p GROUP BY browser_id""",
)
def _(s, d):
    return three_level_stats(view(s, d, "req"), "browser_id", "site_id", "visit_id")


@query("agg_histogram", "SELECT size, count(*) AS n FROM (SELECT cluster_id, count(*) AS size FROM bk GROUP BY cluster_id) x GROUP BY size")
def _(s, d):
    return histogram(view(s, d, "bk"), "cluster_id")


@query("agg_hist_pct", "SELECT size, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM (SELECT cluster_id, count(*) AS size FROM bk GROUP BY cluster_id) x GROUP BY size")
def _(s, d):
    return histogram(view(s, d, "bk"), "cluster_id", share=True)


@query("agg_share_above", "SELECT round(count(*) FILTER (size > 6) * 100.0 / count(*), 6)::DOUBLE AS pct FROM (SELECT cluster_id, count(*) AS size FROM bk GROUP BY cluster_id) x")
def _(s, d):
    return share_above(view(s, d, "bk"), "cluster_id", 6)


_PIVOT = "SELECT visit_id, " + ", ".join(f"count(*) FILTER (browser_id = '{p}') AS n_{p}" for p in PROFILES) + " FROM ck WHERE first_party_cookie GROUP BY visit_id"


def _pivot(s, d):
    return profile_pivot(view(s, d, "ck").filter("first_party_cookie"), "visit_id", "browser_id", PROFILES)


@query("agg_countif_pivot", _PIVOT)
def _(s, d):
    return _pivot(s, d)


@query("agg_filter_clause", "SELECT count(*) FILTER (first_party_cookie) AS fp, count(*) FILTER (NOT first_party_cookie) AS tp, count(*) FILTER (first_party_cookie IS NULL) AS unknown FROM ck")
def _(s, d):
    f = F.col("first_party_cookie")
    return view(s, d, "ck").agg(F.count_if(f).alias("fp"), F.count_if(~f).alias("tp"), F.count_if(f.isNull()).alias("unknown"))


_HERE = " + ".join(f"(n_{p} > 0)::INT" for p in PROFILES)


_SITES = _PIVOT.replace("visit_id", "site_id")


@query("agg_presence_all", f"WITH p AS ({_SITES}) SELECT * FROM p WHERE {_HERE} = 5")
def _(s, d):
    return presence(profile_pivot(view(s, d, "ck").filter("first_party_cookie"), "site_id", "browser_id", PROFILES), PROFILES, "all")


@query("agg_presence_any_missing", f"WITH p AS ({_PIVOT}) SELECT * FROM p WHERE {_HERE} < 5")
def _(s, d):
    return presence(_pivot(s, d), PROFILES, "any")


@query("agg_presence_exactly_one", "SELECT visit_id, url, min(browser_id) AS profile FROM req GROUP BY visit_id, url HAVING count(DISTINCT browser_id) = 1")
def _(s, d):
    g = view(s, d, "req").groupBy("visit_id", "url").agg(F.collect_set("browser_id").alias("p"))
    return g.filter(F.size("p") == 1).select("visit_id", "url", F.col("p")[0].alias("profile"))


@query("agg_both_contexts", "SELECT host, count(*) FILTER (first_party_cookie) AS fp, count(*) FILTER (NOT first_party_cookie) AS tp FROM ck GROUP BY host HAVING fp > 0 AND tp > 0")
def _(s, d):
    return both_contexts(view(s, d, "ck"), "host", "first_party_cookie")


@query("agg_pct_scalar_subq", "SELECT count(*) FILTER (ok) AS n, round(count(*) FILTER (ok) * 100.0 / count(*), 6)::DOUBLE AS pct FROM (SELECT url, bool_or(is_tracker) AS ok FROM req GROUP BY url) x")
def _(s, d):
    return pct_of_distinct(view(s, d, "req"), "url", F.col("is_tracker"))


@query("agg_zero_groups", "SELECT response_url, count(content_hash) AS n FROM res GROUP BY response_url HAVING n = 0")
def _(s, d):
    return zero_groups(view(s, d, "res"), "response_url", "content_hash")


@query("agg_logical_or", "SELECT browser_id, name, coalesce(bool_or(first_party_cookie), false) AS any_true FROM ck GROUP BY ALL")
def _(s, d):
    return logical_or(view(s, d, "ck"), F.col("first_party_cookie"), "browser_id", "name")


@query("agg_any_value", "SELECT hash, min(slot) AS slot FROM mem GROUP BY hash")
def _(s, d):
    return view(s, d, "mem").groupBy("hash").agg(F.min("slot").alias("slot"))


@query("agg_array_distinct_sorted", "SELECT cluster_id, list(DISTINCT cookie ORDER BY cookie) AS cookies FROM bk GROUP BY cluster_id")
def _(s, d):
    return view(s, d, "bk").groupBy("cluster_id").agg(F.array_sort(F.collect_set("cookie")).alias("cookies"))


@query("agg_array_dups", "SELECT cluster, list(site_id ORDER BY site_id) AS sites FROM mem GROUP BY cluster")
def _(s, d):
    return view(s, d, "mem").groupBy("cluster").agg(F.array_sort(F.collect_list("site_id")).alias("sites"))


@query("agg_array_struct_ordered", "SELECT cluster, to_json(list(DISTINCT {'url': url, 'cookie_name': cookie_name} ORDER BY {'url': url, 'cookie_name': cookie_name}))::VARCHAR AS payload FROM mem GROUP BY cluster")
def _(s, d):
    return view(s, d, "mem").groupBy("cluster").agg(F.to_json(F.array_sort(F.collect_set(F.struct("url", "cookie_name")))).alias("payload"))


@query("agg_slot_conditional_arrays", "SELECT cluster, slot, list(DISTINCT url ORDER BY url) AS urls FROM mem GROUP BY ALL")
def _(s, d):
    return slot_arrays(view(s, d, "mem")).select("cluster", F.explode("slots").alias("slot", "urls"))


def slot_arrays(members: DataFrame) -> DataFrame:
    """Per cluster a map from slot to its distinct URLs, instead of one column for each slot."""
    per = members.groupBy("cluster", "slot").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return per.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "urls")))).alias("slots"))


def slot_struct_arrays(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster an array of (slot, url, cookies[]); clusters without members get an empty array."""
    per = members.groupBy("cluster", "slot", "url").agg(F.array_sort(F.collect_set("cookie_name")).alias("cookies"))
    own = per.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("slot", "url", "cookies"))).alias("scripts"))
    empty = F.array().cast("array<struct<slot:string,url:string,cookies:array<string>>>")
    return clusters.join(own, "cluster", "left").withColumn("scripts", F.coalesce("scripts", empty))


@query(
    "agg_slot_struct_arrays",
    """WITH per AS (SELECT cluster, slot, url, list(DISTINCT cookie_name) AS c FROM mem GROUP BY ALL)
    SELECT s_suppkey AS cluster, count(per.url) AS n_scripts, coalesce(sum(len(c)), 0)::BIGINT AS n_cookies FROM supplier LEFT JOIN per ON cluster = s_suppkey GROUP BY s_suppkey""",
)
def _(s, d):
    clusters = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cluster"))
    out = slot_struct_arrays(view(s, d, "mem"), clusters)
    n = F.aggregate("scripts", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["cookies"]))
    return out.select("cluster", F.size("scripts").cast("bigint").alias("n_scripts"), n.alias("n_cookies"))


@query("agg_median_approx", "SELECT browser_id, quantile_disc(lifetime_days, 0.5) AS median_disc, round(quantile_cont(lifetime_days, 0.5), 6) AS median FROM ck GROUP BY browser_id")
def _(s, d):
    return medians(view(s, d, "ck"), "browser_id", "lifetime_days")


@query("agg_safe_divide_avg", "SELECT round(avg(CASE WHEN tp = 0 THEN NULL ELSE fp * 1.0 / tp END), 6)::DOUBLE AS ratio FROM (SELECT name, count(*) FILTER (first_party_cookie) AS fp, count(*) FILTER (NOT first_party_cookie) AS tp FROM ck GROUP BY name) x")
def _(s, d):
    g = view(s, d, "ck").groupBy("name").agg(F.count_if("first_party_cookie").alias("fp"), F.count_if(~F.col("first_party_cookie")).alias("tp"))
    return g.agg(r6(F.avg(F.try_divide("fp", "tp"))).alias("ratio"))


@query("agg_array_delta_sum", "SELECT sum(len(raw) - len(kept))::BIGINT AS removed FROM (SELECT cluster, list(DISTINCT cookie_name) AS raw, list(DISTINCT left(cookie_name, 4)) AS kept FROM mem GROUP BY cluster) x")
def _(s, d):
    g = view(s, d, "mem").groupBy("cluster").agg(F.collect_set("cookie_name").alias("raw"), F.collect_set(F.substring("cookie_name", 1, 4)).alias("kept"))
    return g.agg(F.sum(F.size("raw") - F.size("kept")).alias("removed"))


@query("agg_sum_share", "SELECT cluster, round(count(*) FILTER (first_party_script) * 1.0 / nullif(count(first_party_script), 0), 6)::DOUBLE AS fp_share FROM mem GROUP BY cluster")
def _(s, d):
    f = F.col("first_party_script")
    return view(s, d, "mem").groupBy("cluster").agg(r6(F.try_divide(F.count_if(f), F.count(f))).alias("fp_share"))


@query("agg_google_share", "SELECT cluster, round(count(DISTINCT url) FILTER (url LIKE '%google%') * 1.0 / count(DISTINCT url), 6)::DOUBLE AS share FROM mem GROUP BY cluster")
def _(s, d):
    u = view(s, d, "mem").select("cluster", "url").distinct()
    return u.groupBy("cluster").agg(r6(F.count_if(F.col("url").contains("google")) / F.count("*")).alias("share"))


@query(
    "agg_scalar_bundle",
    """SELECT (SELECT count(*) FROM req) AS requests, (SELECT count(DISTINCT url) FROM req) AS urls, (SELECT count(*) FROM ck) AS cookies,
    (SELECT count(DISTINCT name) FROM ck) AS names, (SELECT count(DISTINCT cluster) FROM mem) AS clusters, (SELECT count(DISTINCT hash) FROM mem) AS hashes, (SELECT count(DISTINCT site_id) FROM mem) AS sites""",
)
def _(s, d):
    a = view(s, d, "req").agg(F.count("*").alias("requests"), F.countDistinct("url").alias("urls"))
    b = view(s, d, "ck").agg(F.count("*").alias("cookies"), F.countDistinct("name").alias("names"))
    c = view(s, d, "mem").agg(*(F.countDistinct(x).alias(n) for x, n in (("cluster", "clusters"), ("hash", "hashes"), ("site_id", "sites"))))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("join_cross_scalar", "SELECT (SELECT count(*) FROM res) AS responses, (SELECT count(*) FROM js) AS calls, round((SELECT count(*) FROM js) * 1.0 / (SELECT count(*) FROM res), 6)::DOUBLE AS calls_per_response")
def _(s, d):
    both = view(s, d, "res").agg(F.count("*").alias("responses")).crossJoin(view(s, d, "js").agg(F.count("*").alias("calls")))
    return both.withColumn("calls_per_response", r6(F.col("calls") / F.col("responses")))


@query("agg_category_distribution", "SELECT category, count(*) AS n FROM (SELECT DISTINCT name, host, CASE WHEN host LIKE 'd1%' THEN 'ads' WHEN host LIKE 'd2%' THEN 'analytics' END AS category FROM ck) x GROUP BY category")
def _(s, d):
    cat = F.when(F.col("host").startswith("d1"), "ads").when(F.col("host").startswith("d2"), "analytics").alias("category")
    return view(s, d, "ck").select("name", "host", cat).distinct().groupBy("category").agg(F.count("*").alias("n"))


@query("agg_hold_id_consistency", "SELECT name, count(*) FILTER (ok) AS n_true, count(*) FILTER (NOT ok) AS n_false FROM (SELECT name, host, bool_and(length(value) >= 8) AS ok FROM ck GROUP BY ALL) x GROUP BY name HAVING n_true = 0 OR n_false = 0")
def _(s, d):
    per = view(s, d, "ck").groupBy("name", "host").agg(F.bool_and(F.length("value") >= 8).alias("ok"))
    g = per.groupBy("name").agg(F.count_if("ok").alias("n_true"), F.count_if(~F.col("ok")).alias("n_false"))
    return g.filter("n_true = 0 or n_false = 0")


@query(
    "agg_value_counts_share",
    """WITH c AS (SELECT cluster, url, count(*) AS n FROM mem WHERE url NOT LIKE '%google%' GROUP BY ALL)
    SELECT cluster, url, n, round(n * 1.0 / sum(n) OVER (PARTITION BY cluster), 6)::DOUBLE AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, url) AS rank FROM c QUALIFY rank <= 3""",
)
def _(s, d):
    return value_counts_share(view(s, d, "mem").filter(~F.col("url").contains("google")), "cluster", "url", 3)


def value_counts_share(df: DataFrame, group: str, value: str, top: int) -> DataFrame:
    """The most frequent values of each group with their share; counts are combined before the windows."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    share = r6(F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return n.select("*", share.alias("share"), rank.alias("rank")).filter(F.col("rank") <= top)


@query("agg_weighted_groupby_sort", "SELECT name, first_party_cookie, round(sum(lifetime_days), 4) AS total FROM ck GROUP BY ALL ORDER BY total DESC, name")
def _(s, d):
    return view(s, d, "ck").groupBy("name", "first_party_cookie").agg(F.round(F.sum("lifetime_days"), 4).alias("total")).orderBy(F.desc("total"), "name")


@query("agg_np_summary", "SELECT min(n_chars) AS min_n, max(n_chars) AS max_n, round(avg(n_chars), 6) AS avg_n, round(stddev_pop(n_chars), 6) AS stddev_n FROM documents")
def _(s, d):
    return stats(s.read.parquet(f"{d}/documents.parquet"), "n_chars", population=True)


@query("agg_distinct_hashes_by_party", "SELECT first_party_script, count(DISTINCT hash) AS n FROM mem GROUP BY first_party_script")
def _(s, d):
    return view(s, d, "mem").groupBy("first_party_script").agg(F.countDistinct("hash").alias("n"))


@query("agg_topk_cookies", "SELECT cookie_name, count(DISTINCT cluster) AS clusters, count(*) FILTER (first_party_script) AS fp, count(*) FILTER (NOT first_party_script) AS tp FROM mem GROUP BY cookie_name ORDER BY clusters DESC, fp DESC, cookie_name LIMIT 10")
def _(s, d):
    f = F.col("first_party_script")
    g = view(s, d, "mem").groupBy("cookie_name").agg(F.countDistinct("cluster").alias("clusters"), F.count_if(f).alias("fp"), F.count_if(~f).alias("tp"))
    return g.orderBy(F.desc("clusters"), F.desc("fp"), "cookie_name").limit(10)


@query("agg_cluster_counts", "SELECT count(*) FILTER (tp = 0) AS only_fp, count(*) FILTER (fp = 0) AS only_tp, count(*) FILTER (fp > 0 AND tp > 0) AS both_n FROM (SELECT hash, count(*) FILTER (first_party_script) AS fp, count(*) FILTER (NOT first_party_script) AS tp FROM mem GROUP BY hash) x")
def _(s, d):
    f = F.col("first_party_script")
    g = view(s, d, "mem").groupBy("hash").agg(F.count_if(f).alias("fp"), F.count_if(~f).alias("tp"))
    return g.agg(F.count_if(F.expr("tp = 0")).alias("only_fp"), F.count_if(F.expr("fp = 0")).alias("only_tp"), F.count_if(F.expr("fp > 0 and tp > 0")).alias("both_n"))


@query("hist_fixed_bins", "SELECT least(floor((lifetime_days - 0) * 25 / 500.0)::INT, 24) AS bin, count(*) AS n FROM ck WHERE lifetime_days BETWEEN 0 AND 500 GROUP BY bin")
def _(s, d):
    return fixed_bins(view(s, d, "ck"), "lifetime_days", 0.0, 500.0, 25)


@query("hist_log_bins", "SELECT least(floor(log10(n_chars) * 30 / 6.0)::INT, 29) AS bin, count(*) AS n FROM documents WHERE n_chars > 0 AND log10(n_chars) BETWEEN 0 AND 6 GROUP BY bin")
def _(s, d):
    return fixed_bins(s.read.parquet(f"{d}/documents.parquet"), "n_chars", 0.0, 6.0, 30, log=True)


@query("pct_of_scope", "SELECT browser_id, round(count(DISTINCT site_id) * 100.0 / 150, 6)::DOUBLE AS pct FROM req GROUP BY browser_id")
def _(s, d):
    return view(s, d, "req").groupBy("browser_id").agg(r6(F.countDistinct("site_id") * 100.0 / 150).alias("pct"))


@query("count_by_party", "SELECT browser_id, url = top_level_url AS first_party, count(*) AS n FROM req GROUP BY ALL")
def _(s, d):
    return view(s, d, "req").groupBy("browser_id", (F.col("url") == F.col("top_level_url")).alias("first_party")).agg(F.count("*").alias("n"))


@query("count_by_tracker", "SELECT browser_id, is_tracker, count(*) AS n FROM req GROUP BY ALL")
def _(s, d):
    return count_by(view(s, d, "req"), "browser_id", "is_tracker")


@query("distinct_pages_per_site", "SELECT site_id, count(DISTINCT visit_id) AS pages, count(DISTINCT visit_id) FILTER (is_tracker) AS tracked FROM req GROUP BY site_id")
def _(s, d):
    return view(s, d, "req").groupBy("site_id").agg(F.countDistinct("visit_id").alias("pages"), F.countDistinct(F.when(F.col("is_tracker"), F.col("visit_id"))).alias("tracked"))


@query("visited_counts", "SELECT multi, count(DISTINCT site_id) AS sites, count(DISTINCT visit_id) AS pages FROM mem JOIN (SELECT cluster, count(DISTINCT cookie_name) > 30 AS multi FROM mem GROUP BY cluster) x USING (cluster) GROUP BY multi")
def _(s, d):
    m = view(s, d, "mem")
    multi = m.groupBy("cluster").agg((F.countDistinct("cookie_name") > 30).alias("multi"))
    return m.join(multi, "cluster").groupBy("multi").agg(F.countDistinct("site_id").alias("sites"), F.countDistinct("visit_id").alias("pages"))


@query("pages_for_sites", "SELECT count(DISTINCT visit_id) AS pages FROM req WHERE site_id IN (SELECT site_id FROM mem WHERE url LIKE '%google%')")
def _(s, d):
    sites = view(s, d, "mem").filter(F.col("url").contains("google")).select("site_id")
    return view(s, d, "req").join(sites, "site_id", "left_semi").agg(F.countDistinct("visit_id").alias("pages"))


@query("script_table_per_cluster", "SELECT cluster, count(DISTINCT hash) AS scripts, count(DISTINCT site_id) AS sites, count(*) FILTER (first_party_script) AS fp, count(*) FILTER (NOT first_party_script) AS tp, count(DISTINCT url) AS urls FROM mem GROUP BY cluster")
def _(s, d):
    f = F.col("first_party_script")
    return view(s, d, "mem").groupBy("cluster").agg(F.countDistinct("hash").alias("scripts"), F.countDistinct("site_id").alias("sites"), F.count_if(f).alias("fp"), F.count_if(~f).alias("tp"), F.countDistinct("url").alias("urls"))


@query("third_party_domains_per_cluster", "SELECT DISTINCT cluster, regexp_extract(url, '://[^/]*?([^./]+\\.[^./]+)/', 1) AS domain FROM mem WHERE NOT first_party_script")
def _(s, d):
    return view(s, d, "mem").filter(~F.col("first_party_script")).select("cluster", F.regexp_extract("url", r"://[^/]*?([^./]+\.[^./]+)/", 1).alias("domain")).distinct()


@query("profile_pivot_per_cluster", "SELECT cluster, " + ", ".join(f"count(*) FILTER (profile = '{p}') AS n_{p}" for p in "ANR") + " FROM mem GROUP BY cluster")
def _(s, d):
    return profile_pivot(view(s, d, "mem"), "cluster", "profile", "ANR")


@query("cluster_url_table", "SELECT DISTINCT cluster, url FROM mem")
def _(s, d):
    return view(s, d, "mem").select("cluster", "url").distinct()


@query("cookies_union_slots", "SELECT cluster, slot, count(DISTINCT cookie_name) AS n FROM mem WHERE first_party_script GROUP BY ALL")
def _(s, d):
    return view(s, d, "mem").filter("first_party_script").select("cluster", "slot", "cookie_name").distinct().groupBy("cluster", "slot").agg(F.count("*").alias("n"))
