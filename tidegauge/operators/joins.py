"""Joins, and updates expressed as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.prefix_join import prefixes_of
from tidegauge.plans.views import select, view
from tidegauge.registry import query

#: A side is broadcast only up to this many counted rows.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame has at most ``most`` rows (counted), else the frame itself."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cookie_calls(cookies: DataFrame, calls: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Cookie records with their script calls by profile, visit, ordinal (and more keys)."""
    calls = calls.withColumnRenamed("page_scoped_event_ordinal", "event_ordinal").withColumnRenamed("value", "call_value")
    return cookies.join(calls.drop(*({"site_id"} - set(more))), ["browser_id", "visit_id", "event_ordinal", *more])


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: dict[str, Column], guarded: bool = False) -> DataFrame:
    """UPDATE ... FROM: aggregate the source to one row per key first, then overwrite (or, guarded, fill nulls of) the columns.

    ``columns`` maps a target column to an aggregate over the source.
    """
    agg = source.groupBy(*keys).agg(*(c.alias(f"_new_{n}") for n, c in columns.items()), F.lit(True).alias("_hit"))
    out = target.join(agg, list(keys), "left")
    for n in columns:
        old = F.col(n) if n in target.columns else F.lit(None)
        new = F.col(f"_new_{n}")
        out = out.withColumn(n, F.coalesce(old, new) if guarded else F.when(F.col("_hit"), new).otherwise(old))
    return out.drop("_hit", *(f"_new_{n}" for n in columns))


def flag_in(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """SET flag = (key IN (...)) without nulls among the keys; a null key stays unknown."""
    hit = keys.select(on).distinct().withColumn("_hit", F.lit(True))
    out = df.join(hit, on, "left")
    return out.withColumn(flag, F.when(F.col(on).isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_hit")


def longest_prefix(values: DataFrame, col: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each distinct value with the longest listed prefix that it starts with (null if none)."""
    return prefixes_of(values, col, prefixes, prefix)


def name_overlap(ours: DataFrame, theirs: DataFrame, name: str) -> DataFrame:
    """One row: distinct names of both sides, names in both, ours that start with one of theirs, theirs that start with one of ours, and the percentages (of ours, ours, theirs).

    Empty names are names, but no prefixes and without any.
    """
    a, b = (x.select(name).filter(F.col(name).isNotNull()).distinct() for x in (ours, theirs))
    one = lambda df, n: F.broadcast(df.agg(F.count("*").alias(n)))  # noqa: E731  (a row each)
    full, other = a.filter(F.col(name) != ""), b.filter(F.col(name) != "")
    prefix = lambda v, p: prefixes_of(v, name, p.withColumnRenamed(name, "_p"), "_p").filter("_p IS NOT NULL").select(name)
    out = one(a, "n_ours").crossJoin(one(b, "n_theirs")).crossJoin(one(a.join(b, name, "left_semi"), "n_exact")).crossJoin(one(prefix(full, other), "n_prefix")).crossJoin(one(prefix(other, full), "n_reverse"))
    pct = lambda n, of: F.round(F.try_divide(F.col(n) * 100.0, F.col(of)), 2)
    return out.select("*", pct("n_exact", "n_ours").alias("exact_pct"), pct("n_prefix", "n_ours").alias("prefix_pct"), pct("n_reverse", "n_theirs").alias("reverse_pct"))


def domain_variants(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def domain_lookup(urls: DataFrame, host: str, table: DataFrame, fields: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Distinct hosts with the fields of the most specific listed domain, else the default."""
    h = urls.select(host).distinct()
    variants = h.select(host, F.posexplode(domain_variants(F.col(host))).alias("_nth", "domain")).join(table, "domain")
    best = variants.groupBy(host).agg(*(F.min_by(f, "_nth").alias(f) for f in fields))
    return h.join(best, host, "left").fillna(default, list(fields))


@query("join_cookie_js", "SELECT c.event_ordinal, c.name, j.operation, j.script_url FROM ck c JOIN js j ON c.browser_id = j.browser_id AND c.visit_id = j.visit_id AND c.event_ordinal = j.page_scoped_event_ordinal WHERE c.first_party_cookie")
def _(s, d):
    return cookie_calls(view(s, d, "ck").filter("first_party_cookie"), view(s, d, "js")).select("event_ordinal", "name", "operation", "script_url")


@query("join_cookie_js_4key", "SELECT c.event_ordinal, c.name, j.operation, j.copy FROM ck c JOIN js j ON c.browser_id = j.browser_id AND c.visit_id = j.visit_id AND c.event_ordinal = j.page_scoped_event_ordinal AND c.site_id = j.site_id")
def _(s, d):
    return cookie_calls(view(s, d, "ck"), view(s, d, "js"), ["site_id"]).select("event_ordinal", "name", "operation", "copy")


@query("join_req_res_by_id", "SELECT q.request_id, q.url, r.content_hash FROM req q JOIN res r USING (browser_id, visit_id, request_id)")
def _(s, d):
    return view(s, d, "req").join(view(s, d, "res").drop("site_id"), ["browser_id", "visit_id", "request_id"]).select("request_id", "url", "content_hash")


@query("join_req_res_by_url", "SELECT q.request_id, r.request_id AS response_id FROM req q JOIN res r ON q.browser_id = r.browser_id AND q.visit_id = r.visit_id AND q.url = r.response_url AND r.content_hash IS NOT NULL")
def _(s, d):
    r = view(s, d, "res").filter("content_hash is not null").select("browser_id", "visit_id", F.col("response_url").alias("url"), F.col("request_id").alias("response_id"))
    return view(s, d, "req").join(r, ["browser_id", "visit_id", "url"]).select("request_id", "response_id")


_SCRIPTED = "(SELECT browser_id, visit_id, concat('https://cdn', cast(request_id % 50 AS string), '.example.com/s', cast(request_id % 20 AS string), '.js') AS response_url, content_hash FROM res)"


@query("join_res_script_url", f"SELECT j.page_scoped_event_ordinal, r.content_hash FROM js j JOIN {_SCRIPTED} r ON j.browser_id = r.browser_id AND j.visit_id = r.visit_id AND r.response_url = j.script_url")
def _(s, d):
    n = lambda m: (F.col("request_id") % m).cast("string")
    r = view(s, d, "res").select("browser_id", "visit_id", F.concat(F.lit("https://cdn"), n(50), F.lit(".example.com/s"), n(20), F.lit(".js")).alias("script_url"), "content_hash")
    return view(s, d, "js").join(r, ["browser_id", "visit_id", "script_url"]).select("page_scoped_event_ordinal", "content_hash")


@query("join_partial_key_fanout", "SELECT c.browser_id, count(*) AS pairs FROM ck c JOIN js j ON c.browser_id = j.browser_id AND c.visit_id = j.visit_id GROUP BY c.browser_id")
def _(s, d):
    return fanout_pairs(view(s, d, "ck"), view(s, d, "js"), ["browser_id", "visit_id"]).groupBy("browser_id").agg(F.sum("pairs").alias("pairs"))


def fanout_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many pairs a join on a partial key makes, per key, from the two sides' counts: the pairs themselves are never made."""
    n = a.groupBy(*keys).agg(F.count("*").alias("_a"))
    m = b.groupBy(*keys).agg(F.count("*").alias("_b"))
    return n.join(m, list(keys)).select(*keys, (F.col("_a") * F.col("_b")).alias("pairs"))


@query(
    "join_multi_cte",
    """WITH a AS (SELECT browser_id, count(*) AS requests FROM req GROUP BY 1), b AS (SELECT browser_id, count(DISTINCT url) AS urls FROM req GROUP BY 1),
    c AS (SELECT browser_id, count(*) AS cookies FROM ck GROUP BY 1), e AS (SELECT browser_id, count(*) AS calls FROM js GROUP BY 1)
    SELECT * FROM a JOIN b USING (browser_id) JOIN c USING (browser_id) JOIN e USING (browser_id)""",
)
def _(s, d):
    a = view(s, d, "req").groupBy("browser_id").agg(F.count("*").alias("requests"), F.countDistinct("url").alias("urls"))
    c = view(s, d, "ck").groupBy("browser_id").agg(F.count("*").alias("cookies"))
    return a.join(c, "browser_id").join(view(s, d, "js").groupBy("browser_id").agg(F.count("*").alias("calls")), "browser_id")


_WIDE = "(SELECT cluster, " + ", ".join(f"max(hash) FILTER (slot = 'cluster_{i}') AS cluster_{i}" for i in range(7)) + " FROM mem GROUP BY cluster)"


@query("join_or_slots", f"SELECT DISTINCT w.cluster, l.hash FROM {_WIDE} w JOIN (SELECT DISTINCT hash FROM mem WHERE first_party_script) l ON " + " OR ".join(f"w.cluster_{i} = l.hash" for i in range(7)))
def _(s, d):
    m = view(s, d, "mem")
    wide = m.groupBy("cluster").agg(*(F.max(F.when(F.col("slot") == f"cluster_{i}", F.col("hash"))).alias(f"cluster_{i}") for i in range(7)))
    return slots_join(wide, [f"cluster_{i}" for i in range(7)], m.filter("first_party_script").select("hash").distinct(), "hash").select("cluster", "hash").distinct()


def slots_join(wide: DataFrame, slots: Sequence[str], other: DataFrame, key: str) -> DataFrame:
    """``a.slot_1 = b.key OR a.slot_2 = b.key OR ...`` as one equi-join on the slots' values, each matched once per row."""
    return wide.withColumn(key, F.explode(F.array_distinct(F.array(*slots)))).join(other, key)


@query("join_comma_where", "SELECT DISTINCT a.cluster, b.cookie_name FROM mem a, (SELECT DISTINCT hash, cookie_name FROM mem WHERE first_party_script) b WHERE a.hash = b.hash")
def _(s, d):
    m = view(s, d, "mem")
    return m.select("cluster", "hash").join(m.filter("first_party_script").select("hash", "cookie_name").distinct(), "hash").select("cluster", "cookie_name").distinct()


@query("join_left_enrich", "SELECT s_suppkey AS cluster, coalesce(c, []) AS cookies FROM supplier LEFT JOIN (SELECT cluster, list(DISTINCT cookie_name ORDER BY cookie_name) AS c FROM mem WHERE first_party_script GROUP BY cluster) x ON cluster = s_suppkey")
def _(s, d):
    own = view(s, d, "mem").filter("first_party_script").groupBy("cluster").agg(F.array_sort(F.collect_set("cookie_name")).alias("cookies"))
    base = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cluster"))
    return base.join(own, "cluster", "left").withColumn("cookies", F.coalesce("cookies", F.array().cast("array<string>")))


@query(
    "join_simhash_map",
    "SELECT m.cluster, m.hash, m.profile, h.simhash_hex FROM mem m LEFT JOIN (SELECT 'A' AS profile, hash, min(md5(hash)) AS simhash_hex FROM mem WHERE profile = 'A' GROUP BY hash UNION ALL SELECT 'R', hash, min(md5(hash)) FROM mem WHERE profile = 'R' GROUP BY hash) h ON m.profile = h.profile AND m.hash = h.hash",
)
def _(s, d):
    m = view(s, d, "mem")
    maps = [m.filter(F.col("profile") == p).groupBy("hash").agg(F.min(F.md5("hash")).alias("simhash_hex")).withColumn("profile", F.lit(p)) for p in "AR"]
    return m.join(maps[0].unionByName(maps[1]), ["profile", "hash"], "left").select("cluster", "hash", "profile", "simhash_hex")


@query(
    "join_prefix_like",
    "SELECT cookie_name, max_by(p, length(p)) AS prefix FROM (SELECT DISTINCT cookie_name FROM mem) c LEFT JOIN (VALUES ('ck_'), ('ck_1'), ('ck_3')) k(p) ON starts_with(cookie_name, p) GROUP BY cookie_name",
)
def _(s, d):
    prefixes = s.createDataFrame([("ck_",), ("ck_1",), ("ck_3",)], "prefix string")
    return longest_prefix(view(s, d, "mem"), "cookie_name", prefixes, "prefix")


@query("join_bundle_cluster", "SELECT r.request_id, m.cluster FROM res r JOIN (SELECT DISTINCT cluster, md5(concat('script', substr(hash, 2))) AS content_hash FROM mem) m USING (content_hash)")
def _(s, d):
    m = view(s, d, "mem").select("cluster", F.md5(F.concat(F.lit("script"), F.expr("substr(hash, 2)"))).alias("content_hash")).distinct()
    return view(s, d, "res").join(m, "content_hash").select("request_id", "cluster")


_TRACKERS = [("google.com", "advertising", "Google"), ("s4.google.com", "cdn", "Google"), ("s7.example.net", "analytics", "Example")]


@query(
    "join_domain_lookup",
    "WITH t(domain, category, organization) AS (VALUES " + ", ".join(map(str, _TRACKERS)) + "), h AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host FROM mem) "
    "SELECT host, coalesce(arg_max(category, length(domain)), 'Unknown') AS category, coalesce(arg_max(organization, length(domain)), 'Unknown') AS organization FROM h LEFT JOIN t ON host = domain OR ends_with(host, '.' || domain) GROUP BY host",
)
def _(s, d):
    t = s.createDataFrame(_TRACKERS, "domain string, category string, organization string")
    hosts = view(s, d, "mem").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return domain_lookup(hosts, "host", t, ["category", "organization"])


@query("join_category_dict", "SELECT name, CASE name WHEN 'ck_1' THEN 'ads' WHEN 'ck_2' THEN 'functional' END AS category, count(*) AS n FROM ck GROUP BY ALL")
def _(s, d):
    t = s.createDataFrame([("ck_1", "ads"), ("ck_2", "functional")], "name string, category string")
    return view(s, d, "ck").groupBy("name").agg(F.count("*").alias("n")).join(F.broadcast(t), "name", "left")  # a literal of two rows


@query("join_in_cookiejar", "SELECT event_ordinal, row_number() OVER (PARTITION BY name, host ORDER BY time_stamp DESC, event_ordinal DESC) = 1 AS in_cookiejar FROM ck")
def _(s, d):
    return in_cookiejar(view(s, d, "ck"), ["name", "host"], ["time_stamp", "event_ordinal"])


def in_cookiejar(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mark the latest record of each key: by an aggregate of the order columns joined back, so a hot key is no single task's window."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return df.join(last, list(keys)).select("event_ordinal", (F.struct(*order) == F.col("_last")).alias("in_cookiejar"))


# Names of ours, and of another list that holds some of them, beginnings of others, and longer ones.
_OURS = "SELECT DISTINCT name FROM ck UNION SELECT ''"
_THEIRS = "SELECT DISTINCT CASE l_partkey % 4 WHEN 0 THEN left(cookie_name, 4) WHEN 1 THEN concat(cookie_name, '_x') WHEN 2 THEN cookie_name ELSE concat('zz', cookie_name) END AS name FROM (SELECT l_partkey, concat('ck_', cast(l_partkey % 60 AS string)) AS cookie_name FROM lineitem) x"


@query(
    "join_prefix_overlap",
    f"""WITH a AS ({_OURS}), b AS ({_THEIRS}), n AS (SELECT (SELECT count(*) FROM a) AS n_ours, (SELECT count(*) FROM b) AS n_theirs, (SELECT count(*) FROM a WHERE name IN (SELECT name FROM b)) AS n_exact,
    (SELECT count(*) FROM a WHERE name <> '' AND EXISTS (SELECT 1 FROM b WHERE b.name <> '' AND starts_with(a.name, b.name))) AS n_prefix, (SELECT count(*) FROM b WHERE name <> '' AND EXISTS (SELECT 1 FROM a WHERE a.name <> '' AND starts_with(b.name, a.name))) AS n_reverse)
    SELECT *, round(n_exact * 100.0 / n_ours, 2)::DOUBLE AS exact_pct, round(n_prefix * 100.0 / n_ours, 2)::DOUBLE AS prefix_pct, round(n_reverse * 100.0 / n_theirs, 2)::DOUBLE AS reverse_pct FROM n""",
)
def _(s, d):
    return name_overlap(select(s, d, _OURS), select(s, d, _THEIRS), "name")


@query("upd_set_where", "SELECT event_ordinal, CASE WHEN length(value) >= 8 THEN true ELSE first_party_cookie END AS first_party_cookie FROM ck")
def _(s, d):
    c = view(s, d, "ck")
    return c.select("event_ordinal", F.when(F.length("value") >= 8, True).otherwise(F.col("first_party_cookie")).alias("first_party_cookie"))


@query("upd_from_join", "SELECT c.event_ordinal, c.name, CASE WHEN j.hit THEN j.any_set END AS set_by_js FROM ck c LEFT JOIN (SELECT browser_id, visit_id, page_scoped_event_ordinal AS o, bool_or(operation = 'set') AS any_set, true AS hit FROM js GROUP BY ALL) j ON c.browser_id = j.browser_id AND c.visit_id = j.visit_id AND c.event_ordinal = j.o")
def _(s, d):
    j = view(s, d, "js").withColumnRenamed("page_scoped_event_ordinal", "event_ordinal")
    return update_from(view(s, d, "ck"), j, ["browser_id", "visit_id", "event_ordinal"], {"set_by_js": F.bool_or(F.col("operation") == "set")}).select("event_ordinal", "name", "set_by_js")


@query("upd_in_subquery", "SELECT request_id, visit_id IN (SELECT visit_id FROM ck WHERE first_party_cookie AND value IS NULL) AS has_fp FROM req")
def _(s, d):
    keys = view(s, d, "ck").filter("first_party_cookie and value is null").select("visit_id")
    return flag_in(view(s, d, "req"), keys, "visit_id", "has_fp").select("request_id", "has_fp")


@query("upd_guarded", "SELECT c.event_ordinal, coalesce(c.first_party_cookie, x.f) AS first_party_cookie FROM ck c LEFT JOIN (SELECT name, bool_or(first_party_cookie) AS f FROM ck GROUP BY name) x USING (name)")
def _(s, d):
    c = view(s, d, "ck")
    return update_from(c, c, ["name"], {"first_party_cookie": F.bool_or("first_party_cookie")}, guarded=True).select("event_ordinal", "first_party_cookie")


@query("upd_loop_columns", "SELECT cluster, slot, min(b) AS bundle FROM (SELECT cluster, slot, hash FROM mem) m LEFT JOIN (SELECT hash, min(cookie_name) AS b FROM mem WHERE first_party_script GROUP BY hash) x USING (hash) GROUP BY ALL")
def _(s, d):
    m = view(s, d, "mem")
    b = m.filter("first_party_script").groupBy("hash").agg(F.min("cookie_name").alias("bundle"))
    return m.select("cluster", "slot", "hash").join(b, "hash", "left").groupBy("cluster", "slot").agg(F.min("bundle").alias("bundle"))


@query("ins_values", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region UNION ALL VALUES (90, 'ATLANTIS'), (91, NULL)")
def _(s, d):
    base = s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name"))
    return base.unionByName(s.createDataFrame([(90, "ATLANTIS"), (91, None)], "k bigint, name string"))


@query("join_unnest_offset_theta", "SELECT a.cookie AS a, b.cookie AS b, count(*) AS n FROM bk a JOIN bk b ON a.cluster_id = b.cluster_id AND a.cookie < b.cookie GROUP BY ALL")
def _(s, d):
    return offset_pairs(view(s, d, "bk").groupBy("cluster_id").agg(F.array_sort(F.collect_set("cookie")).alias("items")), "items").groupBy("a", "b").agg(F.count("*").alias("n"))


def offset_pairs(df: DataFrame, items: str) -> DataFrame:
    """The pairs (a, b) of each array with a before b."""
    left = df.select(items, F.posexplode(items).alias("_i", "a"))
    return left.select("a", F.explode(F.slice(items, F.col("_i") + 2, F.size(items))).alias("b"))


@query("win_visit_ordinal", "SELECT DISTINCT site_id, visit_id, dense_rank() OVER (PARTITION BY site_id ORDER BY subpage_id) - 1 AS ordinal FROM req")
def _(s, d):
    v = view(s, d, "req").select("site_id", "visit_id", "subpage_id").distinct()
    return v.select("site_id", "visit_id", (F.row_number().over(Window.partitionBy("site_id").orderBy("subpage_id")) - 1).alias("ordinal"))
