"""Windows, sorts, top-k, samples and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.overview import r6
from tidegauge.plans.checkpoints import cut
from tidegauge.plans.views import view
from tidegauge.registry import query


def running(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """``_rank`` (from 1) and ``_sum`` (of ``value`` up to the row) in the given order, for any number of rows.

    The rows are dealt out by ranges of the order; each part is numbered and summed on its own, and what the parts before
    it hold is added from a table with a row for each part.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    first = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(first), F.lit(0)).alias("_total"))
    own = Window.partitionBy("_part").orderBy(*order)
    inside = parts.select("*", F.row_number().over(own).alias("_r"), F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    return inside.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_r") + F.col("_rows")).alias("_rank"), (F.col("_s") + F.col("_total")).alias("_sum"))


def _shares(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``rank`` and the unrounded ``_pct`` of the counts up to it, in descending order (ties by key)."""
    total = F.broadcast(counts.agg(F.sum(n).alias("_all")))  # one row
    return running(counts, [F.desc(n), F.col(key)], n).crossJoin(total).select(*counts.columns, F.col("_rank").cast("int").alias("rank"), (F.col("_sum") * 100.0 / F.col("_all")).alias("_pct"))


def coverage(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Cumulative percentage of the counts in descending order (ties by key). Takes one row per key: aggregate first."""
    return _shares(counts, key, n).withColumn("cum_pct", r6(F.col("_pct"))).drop("_pct")


def n_for_coverage(counts: DataFrame, key: str, targets: Sequence[float], n: str = "n") -> DataFrame:
    """(target, n_keys): the smallest number of keys whose counts reach each target percentage, unrounded; 0 for an empty frame."""
    one = _shares(counts, key, n).agg(*(F.min(F.when(F.col("_pct") >= t, F.col("rank"))).alias(f"t{i}") for i, t in enumerate(targets)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("target"), F.coalesce(f"t{i}", F.lit(0)).cast("bigint").alias("n_keys")) for i, t in enumerate(targets)))))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """Empirical distribution function at each distinct value: counts per value first, then their running sum."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("_all")))  # one row
    return running(n, [F.col("x")], "n").crossJoin(total).select("x", r6(F.col("_sum") / F.col("_all")).alias("p"))


def rank_frequency(counts: DataFrame, n: str = "n") -> DataFrame:
    """The counts with their dense rank, the highest first: the distinct counts are ranked, and those are few."""
    ranks = running(counts.select(n).distinct(), [F.desc(n)], n).select(n, F.col("_rank").cast("int").alias("rank"))
    return counts.join(ranks, n)


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order of keys that SQL can spell too."""
    return F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string")).cast("binary"))


def split_exact(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Mark ``int(n * ratio)`` rows as training rows, the first in hash order. The threshold is found from a bounded head, not by numbering all rows.

    Keys are taken to be unique.
    """
    n = int(df.count() * ratio)
    order = hash_order(F.col(key), seed)
    ranked = df.select(order.alias("_h")).groupBy(F.substring("_h", 1, 4).alias("p")).agg(F.count("*").alias("n"))
    w = Window.partitionBy().orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 prefixes
    edge = ranked.select("p", F.sum("n").over(w).alias("c"), "n").filter(F.col("c") >= n).orderBy("p").limit(1).collect()
    if not edge or n == 0:
        return df.withColumn("train", F.lit(False) if n == 0 else F.lit(True))
    prefix, left = edge[0]["p"], n - (edge[0]["c"] - edge[0]["n"])
    last = df.filter(F.substring(order, 1, 4) == prefix).select(order.alias("h")).orderBy("h").limit(left).agg(F.max("h")).first()[0]
    return df.withColumn("train", order <= F.lit(last))


def sample_strata(df: DataFrame, key: str, flag: str, first: int = 50, more_true: int = 25, more_false: int = 25, seed: int = 42) -> DataFrame:
    """The first rows with the flag, and disjoint random ones with and without it. Each stratum is a bounded head."""
    yes, no = df.filter(F.col(flag)), df.filter(~F.col(flag))
    head = yes.orderBy(key).limit(first).select(key, F.lit("first").alias("stratum"))
    rest = yes.join(head, key, "left_anti").orderBy(hash_order(F.col(key), seed)).limit(more_true).select(key, F.lit("true").alias("stratum"))
    other = no.orderBy(hash_order(F.col(key), seed)).limit(more_false).select(key, F.lit("false").alias("stratum"))
    return head.unionByName(rest).unionByName(other)


def membership(df: DataFrame, item: str, group: str) -> DataFrame:
    """How many items belong to exactly each combination of groups."""
    sets = df.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(group)), "&").alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"))


def pairwise_overlap(df: DataFrame, item: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Intersection and both differences of the item sets of each two groups, in one pass over the memberships."""
    here = {g: F.array_contains("s", g) for g in groups}
    sets = df.groupBy(item).agg(F.collect_set(group).alias("s"))
    cols, names = [], []
    for i, a in enumerate(groups):
        for b in groups[i + 1 :]:
            names.append((a, b))
            cols += [F.count_if(here[a] & here[b]), F.count_if(here[a] & ~here[b]), F.count_if(~here[a] & here[b])]
    one = sets.agg(*(c.alias(f"c{i}") for i, c in enumerate(cols)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{3 * i}").alias("n_both"), F.col(f"c{3 * i + 1}").alias("only_a"), F.col(f"c{3 * i + 2}").alias("only_b")) for i, (a, b) in enumerate(names)))
    return one.select(F.inline(rows))


_NAMES = "(SELECT name, count(*) AS n FROM ck GROUP BY name)"


@query("win_cumulative_coverage", f"SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS rank, round(sum(n) OVER (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) * 100.0 / sum(n) OVER (), 6)::DOUBLE AS cum_pct FROM {_NAMES} x")
def _(s, d):
    return coverage(view(s, d, "ck").groupBy("name").agg(F.count("*").alias("n")), "name")


@query("qk_coverage_N", f"SELECT target, (SELECT count(*) + 1 FROM (SELECT sum(n) OVER (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) * 100.0 / sum(n) OVER () AS c FROM {_NAMES} x) y WHERE c < target) AS n_keys FROM (VALUES (80.0), (90.0), (95.0), (99.0)) t(target)")
def _(s, d):
    return n_for_coverage(view(s, d, "ck").groupBy("name").agg(F.count("*").alias("n")), "name", [80.0, 90.0, 95.0, 99.0])


@query("win_ecdf", "SELECT x, round(max(p), 6) AS p FROM (SELECT n_chars AS x, cume_dist() OVER (ORDER BY n_chars) AS p FROM documents) y GROUP BY x")
def _(s, d):
    return ecdf(s.read.parquet(f"{d}/documents.parquet"), "n_chars")


@query("win_rank_frequency", f"SELECT name, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM {_NAMES} x")
def _(s, d):
    n = view(s, d, "ck").groupBy("name").agg(F.count("*").alias("n"))
    return rank_frequency(n).select("name", "n", "rank")


@query("win_latest_per_key", "SELECT name, host, event_ordinal FROM ck QUALIFY row_number() OVER (PARTITION BY name, host ORDER BY time_stamp DESC, event_ordinal DESC) = 1")
def _(s, d):
    last = F.max(F.struct("time_stamp", "event_ordinal")).alias("m")
    return view(s, d, "ck").groupBy("name", "host").agg(last).select("name", "host", "m.event_ordinal")


@query("sort_topk", "SELECT url, count(*) AS n FROM req GROUP BY url ORDER BY n DESC, url LIMIT 10")
def _(s, d):
    return view(s, d, "req").groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(10)


@query("sort_multi", "SELECT cookie, count(*) AS n, min(cluster_id) AS low, max(cluster_id) AS high FROM bk GROUP BY cookie ORDER BY n DESC, low, high, cookie")
def _(s, d):
    return view(s, d, "bk").groupBy("cookie").agg(F.count("*").alias("n"), F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high")).orderBy(F.desc("n"), "low", "high", "cookie")


@query("topk_sum", "SELECT sum(n)::BIGINT AS total FROM (SELECT count(*) AS n FROM req GROUP BY url ORDER BY n DESC, url LIMIT 10) x")
def _(s, d):
    return view(s, d, "req").groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(10).agg(F.sum("n").alias("total"))


@query("topk_site_share", "SELECT cookie_name, count(DISTINCT site_id) AS sites, count(DISTINCT cluster) AS clusters FROM mem GROUP BY cookie_name ORDER BY clusters DESC, sites DESC, cookie_name LIMIT 10")
def _(s, d):
    g = view(s, d, "mem").groupBy("cookie_name").agg(F.countDistinct("site_id").alias("sites"), F.countDistinct("cluster").alias("clusters"))
    return g.orderBy(F.desc("clusters"), F.desc("sites"), "cookie_name").limit(10)


@query("topk_counter", "SELECT cookie, count(*) AS n FROM bk GROUP BY cookie ORDER BY n DESC, cookie LIMIT 7")
def _(s, d):
    return view(s, d, "bk").groupBy("cookie").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cookie").limit(7)


@query("split_train_test", "SELECT page_id, row_number() OVER (ORDER BY md5('42/' || page_id)) <= (SELECT floor(count(*) * 0.9) FROM pages) AS train FROM pages")
def _(s, d):
    return split_exact(s.read.parquet(f"{d}/pages.parquet").select("page_id"), "page_id", 0.9)


@query(
    "sample_strata",
    """WITH f AS (SELECT event_ordinal FROM ck WHERE first_party_cookie ORDER BY event_ordinal LIMIT 50)
    SELECT event_ordinal, 'first' AS stratum FROM f
    UNION ALL (SELECT event_ordinal, 'true' FROM ck WHERE first_party_cookie AND event_ordinal NOT IN (FROM f) ORDER BY md5('42/' || event_ordinal) LIMIT 25)
    UNION ALL (SELECT event_ordinal, 'false' FROM ck WHERE NOT first_party_cookie ORDER BY md5('42/' || event_ordinal) LIMIT 25)""",
)
def _(s, d):
    return sample_strata(view(s, d, "ck"), "event_ordinal", "first_party_cookie")


@query("sample_set_diff", "SELECT DISTINCT md5('42/' || name) AS h, name FROM ck WHERE name NOT IN (SELECT cookie_name FROM mem WHERE cookie_name LIKE 'ck_1%') ORDER BY h LIMIT 25")
def _(s, d):
    taken = view(s, d, "mem").filter("cookie_name like 'ck_1%'").select(F.col("cookie_name").alias("name"))
    left = view(s, d, "ck").select("name").distinct().join(taken, "name", "left_anti")
    return left.select(hash_order(F.col("name"), 42).alias("h"), "name").orderBy("h").limit(25)


@query("head_drop", "SELECT event_ordinal, name FROM ck WHERE event_ordinal NOT IN (3, 5) ORDER BY event_ordinal LIMIT 20")
def _(s, d):
    gone = s.createDataFrame([(3,), (5,)], "event_ordinal bigint")
    return view(s, d, "ck").join(F.broadcast(gone), "event_ordinal", "left_anti").orderBy("event_ordinal").limit(20).select("event_ordinal", "name")


@query("table_sample")
def _(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").sample(fraction=0.01, seed=42).select("l_orderkey", "l_linenumber")


@query("set_union_all", "SELECT url AS x FROM req UNION ALL SELECT response_url FROM res UNION ALL SELECT script_url FROM js UNION ALL SELECT 'literal'")
def _(s, d):
    a = view(s, d, "req").select(F.col("url").alias("x"))
    b = view(s, d, "res").select(F.col("response_url").alias("x"))
    c = view(s, d, "js").select(F.col("script_url").alias("x"))
    return a.unionByName(b).unionByName(c).unionByName(s.range(1).select(F.lit("literal").alias("x")))


@query("set_distinct", "SELECT DISTINCT name, host FROM ck")
def _(s, d):
    return view(s, d, "ck").select("name", "host").distinct()


_OVER = """WITH x AS (SELECT DISTINCT profile AS p, hash FROM mem), pr(a, b) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R'))"""


@query("set_intersect", _OVER + " SELECT a, b, count(*) AS n FROM pr JOIN x xa ON xa.p = a JOIN x xb ON xb.p = b AND xa.hash = xb.hash GROUP BY ALL")
def _(s, d):
    return pairwise_overlap(view(s, d, "mem"), "hash", "profile", "ANR").select("a", "b", F.col("n_both").alias("n"))


@query("set_diff", _OVER + " SELECT a, b, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x xb WHERE xb.p = b AND xb.hash = xa.hash)) AS only_a FROM pr JOIN x xa ON xa.p = a GROUP BY ALL")
def _(s, d):
    return pairwise_overlap(view(s, d, "mem"), "hash", "profile", "ANR").select("a", "b", "only_a")


@query("set_upset_matrix", "SELECT members, count(*) AS n FROM (SELECT hash, string_agg(DISTINCT profile, '&' ORDER BY profile) AS members FROM mem GROUP BY hash) x GROUP BY members")
def _(s, d):
    return membership(view(s, d, "mem"), "hash", "profile")


@query("set_exact_overlap", "SELECT count(*) AS n_both, round(count(*) * 100.0 / (SELECT count(DISTINCT name) FROM ck), 6)::DOUBLE AS pct FROM (SELECT name FROM ck INTERSECT SELECT cookie_name FROM mem) x")
def _(s, d):
    a = view(s, d, "ck").select("name").distinct()
    both = a.intersect(view(s, d, "mem").select("cookie_name")).agg(F.count("*").alias("n_both"))
    return both.crossJoin(a.agg(F.count("*").alias("n"))).select("n_both", r6(F.col("n_both") * 100.0 / F.col("n")).alias("pct"))


@query("set_dedup_order", "SELECT slot, min(l) AS pos FROM (SELECT slot, cluster * 1000 + site_id AS l FROM mem) x GROUP BY slot ORDER BY pos")
def _(s, d):
    return view(s, d, "mem").groupBy("slot").agg(F.min(F.col("cluster") * 1000 + F.col("site_id")).alias("pos")).orderBy("pos")


@query("set_screenshot_intersection", "SELECT DISTINCT split_part(split_part(a.url, '/', 3), '.', 1) AS name FROM pages a WHERE a.page_id % 2 = 0 INTERSECT SELECT split_part(split_part(url, '/', 3), '.', 1) FROM pages WHERE page_id % 2 = 1")
def _(s, d):
    name = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("name")
    p = s.read.parquet(f"{d}/pages.parquet")
    return p.filter("page_id % 2 = 0").select(name).intersect(p.filter("page_id % 2 = 1").select(name))


@query("set_minus_processed", "SELECT DISTINCT url FROM req WHERE url NOT IN (SELECT response_url FROM res WHERE content_hash IS NOT NULL)")
def _(s, d):
    done = view(s, d, "res").filter("content_hash is not null").select(F.col("response_url").alias("url"))
    return view(s, d, "req").select("url").distinct().join(done, "url", "left_anti")


@query("arr_union_key_columns", "SELECT DISTINCT unnest(list_distinct(list_concat(a, b))) AS name FROM (SELECT list(name) FILTER (first_party_cookie) AS a, list(name) FILTER (NOT first_party_cookie) AS b FROM ck GROUP BY browser_id) x")
def _(s, d):
    g = view(s, d, "ck").groupBy("browser_id").agg(F.collect_set(F.when(F.col("first_party_cookie"), F.col("name"))).alias("a"), F.collect_set(F.when(~F.col("first_party_cookie"), F.col("name"))).alias("b"))
    return g.select(F.explode(F.array_union("a", "b")).alias("name")).distinct()
