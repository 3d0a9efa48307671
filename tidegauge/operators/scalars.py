"""Queries that apply the column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.functions import url as U
from tidegauge.operators.io import folder
from tidegauge.plans.views import select, view
from tidegauge.registry import query, table
from tidegauge.sources import readers as R
from tidegauge.sources import writers as W


def pages(s, d):
    return table(s, d, "pages")


#: URLs that the tables lack, by a number from 0 to 11.
ODD = ["?a=&b=1", "http://h/?a=1&a=2", "http://h/?%66oo=1", "http://h/?a+b=1", "http://h/#x?y=1", "h.co.uk/p", "http://10.0.0.1/a/b", "data:text/plain;base64,QUJD", "http://h/?%zz=1&k=v", "", "https://u:p@Www.Shop.co.uk:8080/x/y?q=1#f", "http://h/a/?b&c=="]


def odd(s):
    return s.createDataFrame(list(enumerate(ODD)), "id int, url string")


_ODD = "(VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(ODD)) + ") o(id, url)"
_EACH = f"(SELECT page_id::BIGINT AS id, url FROM pages UNION ALL SELECT -1 - id, url FROM {_ODD})"


def each(s, d):
    return pages(s, d).select(F.col("page_id").alias("id"), "url").unionByName(odd(s).select((-1 - F.col("id")).cast("bigint").alias("id"), "url"))


_ENSURE = r"CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+\-.]*://') THEN url ELSE 'http://' || url END"
_HOST = rf"nullif(lower(regexp_extract({_ENSURE}, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


@query("url_ensure_scheme", f"SELECT id, {_ENSURE} AS full_url FROM {_EACH} x")
def _(s, d):
    return each(s, d).select("id", U.ensure_scheme(F.col("url")).alias("full_url"))


@query("url_host", f"SELECT id, {_HOST} AS host FROM {_EACH} x")
def _(s, d):
    return each(s, d).select("id", U.host(F.col("url")).alias("host"))


_DOMAIN = rf"""CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN NULL WHEN regexp_matches(host, '\.co\.uk$') THEN nullif(regexp_extract(host, '([^.]+\.co\.uk)$', 1), '')
    ELSE nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '') END"""


@query("url_reg_domain", f"SELECT DISTINCT host, {_DOMAIN} AS domain FROM (SELECT {_HOST} AS host FROM {_EACH} x) y WHERE host IS NOT NULL AND host <> 'data'")
def _(s, d):
    hosts = each(s, d).select(U.host(F.col("url")).alias("host")).filter("host is not null and host <> 'data'")
    W.report(s.createDataFrame([("// a list as it is published",), ("",), *((f"{r}  ",) for r in U.SUFFIXES)], "value string"), at := folder(s))
    return U.registrable_domain(hosts, "host", R.public_suffixes(s, at)).select("host", "domain")


@query("url_etld1_tldextract", f"SELECT domain, count(*) AS n FROM (SELECT {_DOMAIN} AS domain FROM (SELECT {_HOST} AS host FROM pages) x) y GROUP BY domain")
def _(s, d):
    h = pages(s, d).select(U.host(F.col("url")).alias("host"))
    return h.join(U.registrable_domain(h, "host"), "host").groupBy("domain").agg(F.count("*").alias("n"))


@query("url_first_party", f"WITH h AS (SELECT request_id, {_HOST} AS host, {_HOST.replace('url', 'top_level_url')} AS top FROM req) SELECT request_id, coalesce(regexp_extract(host, '[^.]+\\.[^.]+$') = regexp_extract(top, '[^.]+\\.[^.]+$'), false) AS first_party FROM h")
def _(s, d):
    r = view(s, d, "req").select("request_id", U.host(F.col("url")).alias("host"), U.host(F.col("top_level_url")).alias("top"))
    domains = U.registrable_domain(r.select("host").union(r.select("top")), "host").select("host", "domain")
    r = r.join(domains, "host", "left").withColumnRenamed("domain", "a").join(domains.toDF("top", "b"), "top", "left")
    return r.select("request_id", U.first_party(F.col("a"), F.col("b")).alias("first_party"))


@query(
    "url_query_keys",
    rf"""SELECT id, list_sort(list_distinct(list_transform(list_filter(string_split(regexp_extract(regexp_extract(url, '^[^#]*'), '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
    lambda p: CASE WHEN regexp_matches(p, '%zz') THEN split_part(p, '=', 1) ELSE url_decode(replace(split_part(p, '=', 1), '+', ' ')) END))) AS keys FROM {_EACH} x""",
)
def _(s, d):
    return each(s, d).select("id", U.query_keys(F.col("url")).alias("keys"))


@query("url_path_segments", rf"SELECT id, CASE WHEN len(g) > 0 THEN list_append(g, g[1]) ELSE g END AS segments FROM (SELECT id, list_transform(list_filter(string_split(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: '/' || x) AS g FROM {_EACH} x) y")
def _(s, d):
    return each(s, d).select("id", U.path_segments(F.col("url")).alias("segments"))


@query("url_strip_query", f"SELECT id, split_part(url, '?', 1) AS bare FROM {_EACH} x")
def _(s, d):
    return each(s, d).select("id", U.strip_query(F.col("url")).alias("bare"))


@query("url_unquote", "SELECT l_orderkey, l_linenumber, url_decode(x) AS decoded, url_decode(x) <> x AS is_encoded FROM (SELECT l_orderkey, l_linenumber, l_shipdate || '+' || CASE WHEN l_quantity > 25 THEN '%20x%C3%A9' ELSE 'y' END AS x FROM lineitem) y")
def _(s, d):
    x = F.concat(F.col("l_shipdate").cast("string"), F.lit("+"), F.when(F.col("l_quantity") > 25, "%20x%C3%A9").otherwise("y")).alias("x")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", x).select("l_orderkey", "l_linenumber", U.decode(F.col("x"), plus=False).alias("decoded"), U.is_encoded(F.col("x")).alias("is_encoded"))


@query("url_strip_data", f"SELECT id, CASE WHEN lower(url) LIKE 'data:%' THEN split_part(url, ',', 1) || ',<data-stripped>' ELSE url END AS url FROM {_EACH} x")
def _(s, d):
    return each(s, d).select("id", U.strip_data(F.col("url")).alias("url"))


@query(
    "url_subpage_filter",
    r"""SELECT page_id, count(*) AS n, min(link) AS low FROM (SELECT page_id, unnest(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1),
    lambda h: CASE WHEN h LIKE 'http%://%' THEN h WHEN h LIKE '/%' THEN base || h END), lambda h: h IS NOT NULL AND starts_with(h, base || '/') AND NOT regexp_matches(lower(regexp_extract(h, '^[^?#]*')), '\.(pdf|jpg|jpeg|png|gif|svg|webp|zip|gz|exe|dmg|mp3|mp4|avi|doc|docx|xls|xlsx|ppt|pptx|css|js|ico|xml)$')), lambda h: split_part(h, '#', 1)))[:25]) AS link
    FROM (SELECT page_id, html, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS base FROM pages) p) x GROUP BY page_id""",
)
def _(s, d):
    links = U.subpages(pages(s, d), "page_id", "url", "html", most=1000)
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.min("link").alias("low"))


@query("str_split_ord", "SELECT DISTINCT visit_id, split_part(visit_id, '_', 1)::BIGINT AS site_id, split_part(visit_id, '_', 2)::BIGINT AS subpage FROM ck")
def _(s, d):
    p = F.split("visit_id", "_")
    return view(s, d, "ck").select("visit_id", p[0].cast("bigint").alias("site_id"), p[1].cast("bigint").alias("subpage")).distinct()


_NAMES = "list_transform(string_split(value, ';'), lambda p: CASE WHEN contains(p, '=') THEN regexp_extract(p, '^([^=]*)=', 1) ELSE '' END)"


@query("str_cookie_name", f"SELECT page_scoped_event_ordinal, copy, {_NAMES} AS names FROM js")
def _(s, d):
    return view(s, d, "js").select("page_scoped_event_ordinal", "copy", T.cookie_names(F.col("value")).alias("names"))


@query("str_cookie_prefix_clean", "SELECT DISTINCT name, CASE WHEN name LIKE 'ck\\_1%' ESCAPE '\\' THEN 'ck_1' WHEN name LIKE 'ck\\_2%' ESCAPE '\\' THEN 'ck_2' ELSE name END AS clean FROM ck")
def _(s, d):
    return view(s, d, "ck").select("name", T.clean_prefix(F.col("name"), ["ck_1", "ck_2"]).alias("clean")).distinct()


@query("str_format_pair", "SELECT DISTINCT cluster, format('({}, {})', slot, profile) AS pair FROM mem")
def _(s, d):
    return view(s, d, "mem").select("cluster", F.format_string("(%s, %s)", "slot", "profile").alias("pair")).distinct()


@query("str_concat_regex", "SELECT page_id, regexp_matches(url, '(' || 'utm_' || '|' || 'page=' || ')') AS hit FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", F.col("url").rlike("(" + "|".join(["utm_", "page="]) + ")").alias("hit"))


@query("str_list_cell", "SELECT n_nationkey, [n_name, 'x y'] AS cells FROM nation")
def _(s, d):
    cell = F.concat(F.lit("['"), F.col("n_name"), F.lit("', x y, ,]"))
    return table(s, d, "nation").select("n_nationkey", T.list_cell(cell).alias("cells"))


@query("str_bool_norm", "SELECT event_ordinal, coalesce(first_party_cookie::VARCHAR IN ('true', '1', 'yes'), false) AS a, coalesce(left(first_party_cookie::VARCHAR, 1) IN ('1', 'true', 't', 'yes'), false) AS b FROM ck")
def _(s, d):
    f = F.col("first_party_cookie").cast("string")
    return view(s, d, "ck").select("event_ordinal", T.as_bool(F.upper(f)).alias("a"), T.as_bool(F.substring(f, 1, 1), ("1", "true", "t", "yes")).alias("b"))


# Calls with the URL in its place, split over line and column, split over function and column, or not there at all.
_BROKEN = """SELECT page_scoped_event_ordinal AS o, copy, CASE WHEN k = 0 THEN script_url WHEN k = 3 THEN NULL ELSE '' END AS u, CASE WHEN k = 0 THEN '12' WHEN k = 1 THEN left(script_url, 10) ELSE '' END AS l,
  CASE k WHEN 0 THEN '7' WHEN 3 THEN '' ELSE substr(script_url, 11) END AS c, CASE k WHEN 1 THEN 'fn' WHEN 4 THEN '' ELSE left(script_url, 10) END AS f FROM (SELECT *, page_scoped_event_ordinal % 5 AS k FROM js) x"""


@query(
    "str_repair_js_fields",
    f"""SELECT o, copy, CASE WHEN coalesce(u, '') <> '' THEN u WHEN l <> '' AND c <> '' THEN l || c WHEN l = '' AND c <> '' AND f <> '' THEN f || c ELSE u END AS script_url,
    CASE WHEN coalesce(u, '') = '' AND c <> '' THEN '' ELSE l END AS script_line,
    CASE WHEN coalesce(u, '') = '' AND c <> '' AND (l <> '' OR f <> '') THEN '' ELSE c END AS script_col,
    CASE WHEN coalesce(u, '') = '' AND c <> '' AND l = '' THEN '' ELSE f END AS func_name, coalesce(u, '') = '' AND c <> '' AND (l <> '' OR f <> '') AS repaired FROM ({_BROKEN}) y""",
)
def _(s, d):
    rows = select(s, d, _BROKEN)
    return rows.select("o", "copy", *T.repair_script_fields(*(F.col(c) for c in "ulcf")))


@query("str_regex_escape", r"SELECT page_id, regexp_replace(url, '([^A-Za-z0-9_])', '\\\1', 'g') AS escaped FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", T.regex_escape(F.col("url")).alias("escaped"))


@query("str_lower_trim_clean", "SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('the', 'and', 'var'))) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.drop_tokens(F.col("text"), ["the", "and", "var"])).cast("bigint").alias("n"))


@query("str_ngrams", "SELECT doc_id, len(g) AS n, len(list_distinct(g)) AS n_distinct, g[1] AS first_gram FROM (SELECT doc_id, list_transform(range(greatest(length(t) - 2, 1)), lambda i: substr(t, i::INT + 1, 3)) AS g FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents) x) y")
def _(s, d):
    t = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    g = table(s, d, "documents").select("doc_id", T.ngrams(t, 3).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n"), F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"), F.col("g")[0].alias("first_gram"))


@query("dt_shift", "SELECT event_id, ts + INTERVAL 2 HOUR AS shifted FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", T.shift(F.col("ts"), 2).alias("shifted"))


@query("dt_parse", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '9999-12-31 23:59:59' ELSE date_trunc('second', ts) + INTERVAL 2 HOUR END::VARCHAR AS parsed FROM events")
def _(s, d):
    raw = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(s, d, "events").select("event_id", F.date_format(T.parse_time(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("dt_epoch1601", "SELECT event_id, date_trunc('second', ts) + INTERVAL 2 HOUR AS t FROM events")
def _(s, d):
    micros = F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) + 11644473600000000
    return table(s, d, "events").select("event_id", T.chrome_time(micros).cast("timestamp_ntz").alias("t"))


@query("dt_cookie_formats", "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN date_trunc('second', ts)::VARCHAR END AS expires FROM events")
def _(s, d):
    f = lambda p: F.concat(F.lit("Mon, "), F.date_format("ts", p), F.lit(" GMT"))
    k = F.col("event_id") % 5
    raw = F.when(k == 0, f("dd-MMM-yyyy HH:mm:ss")).when(k == 1, f("dd MMM yyyy HH:mm:ss")).when(k == 2, f("dd-MM-yyyy HH:mm:ss")).when(k == 3, f("dd MM yyyy HH:mm:ss")).otherwise("0")
    return table(s, d, "events").select("event_id", F.date_format(T.cookie_date(raw), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("math_round_pct", "SELECT cookie, round(count(*) * 100.0 / (SELECT count(DISTINCT cluster_id) FROM bk), 2)::DOUBLE AS pct FROM bk GROUP BY cookie")
def _(s, d):
    b = view(s, d, "bk")
    total = b.agg(F.countDistinct("cluster_id").alias("t"))
    return b.groupBy("cookie").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("cookie", F.round(F.col("n") * 100.0 / F.col("t"), 2).alias("pct"))


@query("math_log2_lift", "SELECT hash, round(log2((a / 100.0 + 1e-6) / (b / 100.0 + 1e-6)), 6) AS lift FROM (SELECT hash, count(*) FILTER (profile = 'A') AS a, count(*) FILTER (profile = 'N') AS b FROM mem GROUP BY hash) x")
def _(s, d):
    g = view(s, d, "mem").groupBy("hash").agg(F.count_if(F.col("profile") == "A").alias("a"), F.count_if(F.col("profile") == "N").alias("b"))
    return g.select("hash", F.round(F.log2((F.col("a") / 100.0 + 1e-6) / (F.col("b") / 100.0 + 1e-6)), 6).alias("lift"))


@query("math_bitcount_xor", "SELECT l_orderkey, l_linenumber, bit_count(xor(l_partkey, l_suppkey)) AS bits FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.hamming(F.col("l_partkey"), F.col("l_suppkey")).alias("bits"))


@query("math_hex_dec", "SELECT c_custkey, c_custkey::BIGINT AS a, c_custkey::BIGINT AS b FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", T.unhex64(F.concat(F.lit("0x"), F.lower(F.hex(k)))).alias("a"), T.unhex64(F.lpad(F.hex(k), 16, "0")).alias("b"))


@query("arr_length", "SELECT cluster_id, count(*) AS n FROM bk GROUP BY cluster_id")
def _(s, d):
    return view(s, d, "bk").groupBy("cluster_id").agg(F.size(F.collect_set("cookie")).cast("bigint").alias("n"))


@query("arr_contains_all", "SELECT cluster_id FROM bk WHERE cookie IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY cluster_id HAVING count(DISTINCT cookie) = 3")
def _(s, d):
    want = F.array(*(F.lit(f"Brand#{i}") for i in (11, 12, 13)))
    return view(s, d, "bk").groupBy("cluster_id").agg(F.collect_set("cookie").alias("c")).filter(F.size(F.array_intersect("c", want)) == 3).select("cluster_id")


@query("arr_unnest", "SELECT cookie, count(*) AS n FROM bk GROUP BY cookie")
def _(s, d):
    g = view(s, d, "bk").groupBy("cluster_id").agg(F.collect_set("cookie").alias("c"))
    return g.select(F.explode("c").alias("cookie")).groupBy("cookie").agg(F.count("*").alias("n"))


@query("arr_unnest_offset", "SELECT cluster_id, cookie, row_number() OVER (PARTITION BY cluster_id ORDER BY cookie) - 1 AS pos FROM bk")
def _(s, d):
    g = view(s, d, "bk").groupBy("cluster_id").agg(F.array_sort(F.collect_set("cookie")).alias("c"))
    return g.select("cluster_id", F.posexplode("c").alias("pos", "cookie"))


@query("arr_generate", "SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1))::BIGINT AS slot FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("l_linenumber").cast("bigint"))).alias("slot"))


@query("json_extract_array", "SELECT cluster, url, count(*) AS n FROM (SELECT cluster, url, cookie_name FROM mem GROUP BY ALL) x GROUP BY ALL")
def _(s, d):
    j = view(s, d, "mem").groupBy("cluster").agg(F.to_json(F.collect_set(F.struct("url", "cookie_name"))).alias("data"))
    rows = j.select("cluster", F.explode(F.from_json("data", "array<struct<url:string,cookie_name:string>>")).alias("x"))
    return rows.groupBy("cluster", F.col("x.url").alias("url")).agg(F.count("*").alias("n"))


@query("json_value", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::VARCHAR AS raw FROM events")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("event_id", k.cast("bigint").alias("k"), k.alias("raw"))


@query("json_keys_pivot", "SELECT sum(USA)::BIGINT AS USA, sum(China)::BIGINT AS China FROM (SELECT event_id % 7 AS USA, event_id % 3 AS China FROM events) x")
def _(s, d):
    j = F.to_json(F.struct((F.col("event_id") % 7).alias("USA"), (F.col("event_id") % 3).alias("China")))
    x = table(s, d, "events").select(F.from_json(j, "USA bigint, China bigint").alias("x"))
    return x.agg(F.sum("x.USA").alias("USA"), F.sum("x.China").alias("China"))


@query("json_dict_nested_keys", "SELECT DISTINCT cookie_name AS k FROM mem")
def _(s, d):
    inner = view(s, d, "mem").groupBy("cluster").agg(F.map_from_entries(F.transform(F.collect_set("cookie_name"), lambda c: F.struct(c, F.lit("1")))).alias("m"))
    j = inner.select(F.to_json(F.create_map(F.col("cluster").cast("string"), F.col("m"))).alias("j"))
    outer = j.select(F.explode(F.map_values(F.from_json("j", "map<string,map<string,string>>"))).alias("m"))
    return outer.select(F.explode(F.map_keys("m")).alias("k")).distinct()


@query("headers_lookup", "SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'text/javascript' WHEN 1 THEN 'text/html' END AS content_type FROM res")
def _(s, d):
    return view(s, d, "res").select("request_id", T.header(F.col("headers"), "Content-Type").alias("content_type"))


@query("cookie_header_parse", "SELECT event_ordinal, name, value, '.' || host AS domain, '/a' AS path, '2027-01-02 03:04:05' AS expires, '60' AS max_age, true AS http_only, event_ordinal % 2 = 0 AS secure FROM ck WHERE value IS NOT NULL")
def _(s, d):
    tail = F.when(F.col("event_ordinal") % 2 == 0, "; Secure").otherwise("")
    raw = F.concat("name", F.lit("="), "value", F.lit("; Domain="), "host", F.lit("; Expires=Sat, 02-Jan-2027 03:04:05 GMT; Max-Age=60; HttpOnly"), tail)
    c = view(s, d, "ck").filter("value is not null").select("event_ordinal", raw.alias("raw"))
    out = c.select("event_ordinal", *T.response_cookie(F.col("raw"), F.lit("https://h.example.com/a/b")))
    return out.withColumn("expires", F.date_format("expires", "yyyy-MM-dd HH:mm:ss"))


@query("cookie_request_parse", "SELECT page_scoped_event_ordinal, copy, unnest(list_transform(list_filter(regexp_split_to_array(value, ';\\s*'), lambda p: contains(p, '=')), lambda p: trim(split_part(p, '=', 1)))) AS name FROM js")
def _(s, d):
    return view(s, d, "js").select("page_scoped_event_ordinal", "copy", F.explode(T.request_cookies(F.col("value"))).alias("c")).select("page_scoped_event_ordinal", "copy", "c.name")


@query("html_category_probe", "SELECT page_id, CASE WHEN html LIKE '%</nav>%' THEN 'nav' WHEN html LIKE '%track(%' THEN 'tracking' END AS category FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", T.category_probe(F.col("html"), [("track(", "tracking"), ("</nav>", "nav")]).alias("category"))


@query("hash_sha1", "SELECT page_id, sha1(html) AS h FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", F.sha1(F.col("html").cast("binary")).alias("h"))


@query("hash_sha256", "SELECT page_id, sha256(html) AS h FROM pages")
def _(s, d):
    return pages(s, d).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("h"))


@query("hash_md5", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query("rec_coerce", "SELECT p_partkey, p_name AS name, to_json({'brand': p_brand, 'size': p_size})::VARCHAR AS record, p_partkey::VARCHAR AS other FROM part")
def _(s, d):
    broken = F.concat(F.unhex(F.lit("ff80")), F.encode("p_name", "UTF-8"), F.unhex(F.lit("c3")))
    record = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return table(s, d, "part").select("p_partkey", T.coerce(broken, "bytes").alias("name"), T.coerce(record, "record").alias("record"), T.coerce(F.col("p_partkey"), "other").alias("other"))


@query("rec_fill_missing", "SELECT r_regionkey::BIGINT AS k, r_name AS name, NULL::VARCHAR AS extra FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def _(s, d):
    a = table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name"))
    b = table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("id_uuid", "SELECT cluster, regexp_replace(md5('{\"c0\":\"' || cluster || '\",\"c1\":' || coalesce('\"' || slot || '\"', 'null') || '}'), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS id FROM (SELECT DISTINCT cluster, CASE WHEN slot <> 'cluster_3' THEN slot END AS slot FROM mem) x")
def _(s, d):
    m = view(s, d, "mem").select("cluster", F.when(F.col("slot") != "cluster_3", F.col("slot")).alias("slot")).distinct()
    return m.select("cluster", T.stable_id(F.col("cluster"), F.col("slot")).alias("id"))


@query("explode_subpages", "SELECT site_id, 0 AS ordinal, concat(site_id, '_0') AS visit_id FROM (SELECT DISTINCT site_id FROM req) x UNION ALL SELECT site_id, o, concat(site_id, '_', o) FROM (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY url) AS o FROM (SELECT DISTINCT site_id, url FROM req) y) z")
def _(s, d):
    lists = view(s, d, "req").groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("url")), "\n").alias("subpages"))
    return explode_subpages(lists, "site_id", "subpages").select("site_id", "ordinal", "visit_id")


def explode_subpages(sites, key, subpages):
    """A newline-separated list per site as rows; the root page is number 0."""
    pages_ = F.concat(F.array(F.lit("")), F.filter(F.split(F.coalesce(subpages, F.lit("")), "\n"), lambda x: x != ""))
    out = sites.select(key, F.posexplode(pages_).alias("ordinal", "page"))
    return out.withColumn("visit_id", F.concat(F.col(key).cast("string"), F.lit("_"), F.col("ordinal").cast("string")))


# Commands of a crawl: page visits and others, with a status and a duration.
_HISTORY = "SELECT event_id, CASE WHEN event_type = 'click' THEN 'BrowseCommand' ELSE 'GetCommand' END AS command, CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'neterror' END AS command_status, cast(event_id % 90000 AS bigint) AS duration, ts AS dtg FROM events"


@query("crawl_history_states", f"SELECT event_id, CASE WHEN command_status IN ('ok', 'timeout') THEN 1 ELSE -1 END AS state, coalesce(command_status = 'timeout', false)::INT AS timeout, dtg + INTERVAL 2 HOUR AS start, dtg + INTERVAL 2 HOUR + to_milliseconds(duration) AS finish FROM ({_HISTORY}) x WHERE command = 'GetCommand'")
def _(s, d):
    h = select(s, d, _HISTORY).withColumn("dtg", F.col("dtg").cast("timestamp")).filter("command = 'GetCommand'")
    out = h.select("event_id", *T.crawl_state(F.col("command_status"), F.col("dtg"), F.col("duration")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@query("any_command_failed", f"SELECT event_id % 100 AS visit_id, bool_or(coalesce(command_status, '') <> 'ok') AS failed FROM ({_HISTORY}) x GROUP BY 1")
def _(s, d):
    return any_failed(select(s, d, _HISTORY).withColumn("visit_id", F.col("event_id") % 100), "visit_id", "command_status")


def any_failed(history, visit, status):
    """Whether a visit has a command whose status isn't ``ok`` (null is not)."""
    return history.groupBy(visit).agg(F.bool_or(F.coalesce(F.col(status), F.lit("")) != "ok").alias("failed"))


@query("js_operation_domain", "SELECT operation, count(*) AS n FROM (SELECT symbol, value, CASE WHEN page_scoped_event_ordinal % 31 = 0 THEN 'other' ELSE operation END AS operation FROM js) x WHERE symbol = 'window.document.cookie' AND value <> '' AND operation IN ('call', 'get', 'get(failed)', 'get(function)', 'set', 'set(failed)', 'set(prevented)') GROUP BY operation")
def _(s, d):
    js = view(s, d, "js").withColumn("operation", F.when(F.col("page_scoped_event_ordinal") % 31 == 0, "other").otherwise(F.col("operation")))
    return cookie_uses(js).groupBy("operation").agg(F.count("*").alias("n"))


def cookie_uses(js):
    """Calls of a known operation that read or write a cookie with a value."""
    return js.filter((F.col("symbol") == "window.document.cookie") & (F.col("value") != "") & T.known_operation(F.col("operation")))


@query("post_body_json", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{\"a\":[\"x y\",\"&\"],\"name\":[\"' || c_name || '\"]}' END AS post_body, CASE c_custkey % 3 WHEN 1 THEN '[[null,\"' || base64(encode(c_name)) || '\"]]' END AS post_body_raw FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 3
    body = F.when(k == 0, F.concat(F.lit("a=x+y&name="), "c_name", F.lit("&a=%26"))).when(k == 1, F.col("c_name")).cast("binary")
    kind = F.when(k == 0, "Application/x-www-form-urlencoded; charset=UTF-8").otherwise("text/plain")
    return table(s, d, "customer").select("c_custkey", *T.post_body(body, kind))


@query("cookie_record_type", "SELECT event_ordinal, CASE WHEN event_ordinal % 7 = 0 THEN 'manual-export' WHEN value IS NULL THEN 'deleted' ELSE 'added-or-changed' END AS record_type FROM ck")
def _(s, d):
    return view(s, d, "ck").select("event_ordinal", T.record_type(F.col("value").isNull(), F.col("event_ordinal") % 7 == 0).alias("record_type"))
