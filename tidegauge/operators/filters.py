"""Projections, filters, predicates and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.views import view
from tidegauge.registry import query

#: Cookie values that hold several key-value pairs in brackets.
MULTI_VALUE = r"\[[^]]*:[^]]*\]|\{[^}]*:[^}]*\}"
PROFILE_CODES = {"click": "EU1", "error": "EU2", "purchase": "US1", "signup": "US2"}

# Fingerprints of script bundlers, tried in this order. A rule is a list of alternatives, each a
# list of patterns that must all be found; a leading "!" means it must not be.
BUNDLERS: list[tuple[str, list[list[str]]]] = [
    (
        "webpack",
        [
            [r"\b__webpack_require__\b"],
            [r"\b__webpack_modules__\b"],
            [r"\b__webpack_module_cache__\b"],
            [r"\b__webpack_exports\b"],
            [r"\b__webpack_hash__\b"],
            [r"\b__webpack_get_script_filename__\b"],
            [r"\bwebpackChunk\b"],
            [r"\bwebpackJsonp\b"],
            [r"\bloaded\s*:\s*!1\b"],
            [r"\bl\s*:\s*!1\b"],
            [r"\bSymbol\.toStringTag\b"],
            ["webpack"],
        ],
    ),
    (
        "parcel",
        [
            [r"\bparcelRequire\b"],
            [r"\bisParcelRequire\b"],
            [r"@parcel/runtime-js"],
            [r"\bnewRequire\("],
            [r"newRequire\.Module"],
            [r"newRequire\.modules"],
            [r"newRequire\.cache"],
            [r"newRequire\.parent"],
            [r"newRequire\.register"],
            [r"\bmodule\.exports\b", r"\brequire\("],
        ],
    ),
    ("vite", [[r"\b__vitePreload\b"], [r"\bimport\.meta\.env\b"], [r"\bmodulepreload\b"], [r"vite/modulepreload"]]),
    ("rollup", [[r"\bcommonjsGlobal\b"], [r"\bgetAugmentedNamespace\b"], [r"typeof\s+globalThis\b"]]),
    (
        "esbuild",
        [
            [r"\b__commonJS\b"],
            [r"\b__toModule\b"],
            [r"\b__markAsModule\b"],
            [r"\b__toCommonJS\b"],
            [r"\b__exportStar\b"],
            [r"\b__create\b"],
            [r"\b__defProp\b"],
            [r"\b__getOwnPropDesc\b"],
            [r"\b__getOwnPropNames\b"],
            [r"\b__getProtoOf\b"],
            [r"\b__reExport\b"],
            [r"\b__require\b"],
            [r"\b__esm\b"],
            [r"\b__export\b"],
        ],
    ),
    ("fusebox", [[r"FuseBox\.pkg\("], [r"FuseBox\.import\("], [r"\$fsx\.r\("], [r"\$fsx\.m\("]]),
    ("browserify", [[r"\bfunction\s+o\s*\(", r"\bMODULE_NOT_FOUND\b"]]),
    # only where no mark of another bundler is found, for most of them not even inside a longer word
    (
        "browserify_like",
        [
            [
                r"Cannot find module",
                r"\bMODULE_NOT_FOUND\b",
                r"!__webpack_require__|__webpack_modules__|__webpack_module_cache__|webpackChunk|webpackJsonp|loaded\s*:\s*!1|\bl\s*:\s*!1|Symbol\.toStringTag"
                r"|parcelRequire|isParcelRequire|@parcel/runtime-js|newRequire\.Module|newRequire\.modules|newRequire\.cache|newRequire\.parent|newRequire\.register"
                r"|\b__vitePreload|import\.meta\.env|modulepreload|vite/modulepreload|commonjsGlobal|getAugmentedNamespace|typeof\s+globalThis"
                r"|__commonJS|__toModule|__markAsModule|__toCommonJS|__exportStar|__create|__defProp|__getOwnPropDesc|__getOwnPropNames|__getProtoOf|__reExport|__require|__esm|__export"
                r"|FuseBox\.pkg\(|FuseBox\.import\(|\$fsx\.r\(|\$fsx\.m\(|function\s+o\s*\(",
            ]
        ],
    ),
]


def bundler(text: Column, rules: Sequence[tuple[str, list[list[str]]]] = tuple(BUNDLERS)) -> Column:
    """Label of the first rule that fits, else ``unknown``."""
    out = None
    for label, alternatives in rules:
        cond = None
        for patterns in alternatives:
            one = None
            for p in patterns:
                hit = ~text.rlike(p[1:]) if p.startswith("!") else text.rlike(p)
                one = hit if one is None else one & hit
            cond = one if cond is None else cond | one
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("unknown")


def entropy_flag(value: Column, least: int = 8) -> Column:
    """True for values of at least ``least`` characters, else null: the flag is never set to false."""
    return F.when(value.isNotNull() & (F.length(value) >= least), True)


def expiry_flag(expiry: Column, seen: Column, days: int = 90, mode: str = "ge_interval") -> Column:
    """True for cookies that live long: ``ge_interval`` days or more, ``gt_whole_days`` more whole days than that; else null."""
    seconds = expiry.cast("double") - seen.cast("double")
    if mode == "ge_interval":
        return F.when(seconds >= days * 86400, True)
    if mode == "gt_whole_days":
        return F.when(F.floor(seconds / 86400) > days, True)
    raise ValueError(mode)


def dominance(fp: Column, tp: Column) -> Column:
    """``third`` where third-party uses are more, else ``first`` (ties too)."""
    return F.when(tp > fp, "third").otherwise("first")


def resource_flags(headers: Column) -> list[Column]:
    """is_javascript, is_setcookie and is_websocket from response headers (case-insensitive)."""
    h = F.lower(headers)
    return [h.contains("javascript").alias("is_javascript"), h.contains("set-cookie").alias("is_setcookie"), h.contains("websocket").alias("is_websocket")]


def profile_code(browser: Column, codes: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in codes.items():
        out = F.when(browser == k, v).otherwise(out)
    return out


@query("proj_star_replace", "SELECT * REPLACE (try_cast(trim(script_line) AS DECIMAL(38, 9))::DOUBLE AS script_line) FROM js")
def _(s, d):
    return view(s, d, "js").withColumn("script_line", F.expr("try_cast(trim(script_line) AS DECIMAL(38, 9))").cast("double"))


@query("type_safe_cast", "SELECT script_line, count(*) AS n, try_cast(trim(script_line) AS BIGINT)::DOUBLE AS line FROM js GROUP BY script_line")
def _(s, d):
    return view(s, d, "js").groupBy("script_line").agg(F.count("*").alias("n")).withColumn("line", F.expr("try_cast(trim(script_line) AS BIGINT)").cast("double"))


@query("proj_star_plus", "SELECT *, length(url) AS url_length FROM req")
def _(s, d):
    return view(s, d, "req").select("*", F.length("url").cast("bigint").alias("url_length"))


@query("proj_rename_generic", "SELECT n_nationkey AS string_field_0, n_name AS country FROM nation")
def _(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").withColumnsRenamed({"n_nationkey": "string_field_0", "n_name": "country"})


@query("filter_bool_flags", "SELECT event_ordinal, name FROM ck WHERE length(value) >= 8 AND lifetime_days >= 90 AND first_party_cookie")
def _(s, d):
    c = view(s, d, "ck")
    return c.filter(entropy_flag(F.col("value")) & (F.col("lifetime_days") >= 90) & F.col("first_party_cookie")).select("event_ordinal", "name")


@query(
    "filter_null_tri",
    "SELECT 'true' AS part, count(*) AS n FROM ck WHERE first_party_cookie UNION ALL SELECT 'false', count(*) FROM ck WHERE NOT first_party_cookie UNION ALL SELECT 'null', count(*) FROM ck WHERE first_party_cookie IS NULL",
)
def _(s, d):
    f = F.col("first_party_cookie")
    part = F.when(f, "true").when(~f, "false").otherwise("null")
    return view(s, d, "ck").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("filter_like", "SELECT page_id, url FROM pages WHERE (url LIKE '%utm_source%' OR url LIKE '%page=%') AND url NOT LIKE '%spam%'")
def _(s, d):
    u = F.col("url")
    return s.read.parquet(f"{d}/pages.parquet").filter((u.like("%utm_source%") | u.like("%page=%")) & ~u.like("%spam%")).select("page_id", "url")


@query("filter_regex_multi_value", r"SELECT event_ordinal, value FROM ck WHERE regexp_matches(value, '\[[^\]]*:[^\]]*\]|\{[^}]*:[^}]*\}')")
def _(s, d):
    return view(s, d, "ck").filter(F.col("value").rlike(MULTI_VALUE)).select("event_ordinal", "value")


@query("filter_in_subquery", "SELECT request_id, url FROM req WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    toxic = s.read.parquet(f"{d}/labels.parquet").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return view(s, d, "req").join(toxic, "page_id", "left_semi").select("request_id", "url")


@query("filter_not_in_subquery", "SELECT DISTINCT name FROM ck WHERE name NOT IN (SELECT name FROM ck WHERE first_party_cookie)")
def _(s, d):
    c = view(s, d, "ck")
    return not_in(c.select("name").distinct(), c.filter("first_party_cookie").select("name"), "name")


def not_in(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Null-aware NOT IN: a null among the taken keys empties the result, a null key is only kept against an empty list."""
    state = taken.agg(F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("_null"), F.count("*").alias("_n"))
    out = df.join(taken.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(state))  # one row
    return out.filter((F.col("_n") == 0) | (~F.col("_null") & F.col(key).isNotNull())).drop("_null", "_n")


@query("filter_array_len", "SELECT cluster_id, len(list(cookie)) AS n FROM bk GROUP BY cluster_id HAVING n > 4")
def _(s, d):
    g = view(s, d, "bk").groupBy("cluster_id").agg(F.collect_set("cookie").alias("c"))
    return g.filter(F.size("c") > 4).select("cluster_id", F.size("c").cast("bigint").alias("n"))


@query("filter_having_alias", "SELECT cookie, count(*) AS cluster_count FROM bk GROUP BY cookie HAVING cluster_count >= 100")
def _(s, d):
    return view(s, d, "bk").groupBy("cookie").agg(F.count("*").alias("cluster_count")).filter("cluster_count >= 100")


# Script texts with a fingerprint each, so that every class has members, and some that only part of a rule fits.
_SCRIPT = "concat(html, CASE page_id % 14 WHEN 0 THEN 'self.webpackChunk=[]' WHEN 1 THEN 'parcelRequire(1)' WHEN 2 THEN 'import.meta.env' WHEN 3 THEN 'commonjsGlobal' WHEN 4 THEN '__toCommonJS' WHEN 5 THEN 'FuseBox.pkg(' WHEN 6 THEN 'function o (e) MODULE_NOT_FOUND' WHEN 7 THEN 'Cannot find module MODULE_NOT_FOUND' WHEN 8 THEN 'Cannot find module MODULE_NOT_FOUND x__createy' WHEN 9 THEN 'Cannot find module MODULE_NOT_FOUND {null:!1}' WHEN 10 THEN 'Cannot find module MODULE_NOT_FOUND x__vitePreloady' WHEN 11 THEN 'module.exports=require(1)' WHEN 12 THEN 'module.exports=1' ELSE '' END)"
_BUNDLE = r"""CASE
  WHEN regexp_matches(t, '\b__webpack_require__\b|\b__webpack_modules__\b|\b__webpack_module_cache__\b|\b__webpack_exports\b|\b__webpack_hash__\b|\b__webpack_get_script_filename__\b|\bwebpackChunk\b|\bwebpackJsonp\b|\bloaded\s*:\s*!1\b|\bl\s*:\s*!1\b|\bSymbol\.toStringTag\b') OR contains(t, 'webpack') THEN 'webpack'
  WHEN regexp_matches(t, '\bparcelRequire\b|\bisParcelRequire\b|@parcel/runtime-js|\bnewRequire\(|newRequire\.Module|newRequire\.modules|newRequire\.cache|newRequire\.parent|newRequire\.register') OR (regexp_matches(t, '\bmodule\.exports\b') AND regexp_matches(t, '\brequire\(')) THEN 'parcel'
  WHEN regexp_matches(t, '\b__vitePreload\b|\bimport\.meta\.env\b|\bmodulepreload\b|vite/modulepreload') THEN 'vite'
  WHEN regexp_matches(t, '\bcommonjsGlobal\b|\bgetAugmentedNamespace\b|typeof\s+globalThis\b') THEN 'rollup'
  WHEN regexp_matches(t, '\b__commonJS\b|\b__toModule\b|\b__markAsModule\b|\b__toCommonJS\b|\b__exportStar\b|\b__create\b|\b__defProp\b|\b__getOwnPropDesc\b|\b__getOwnPropNames\b|\b__getProtoOf\b|\b__reExport\b|\b__require\b|\b__esm\b|\b__export\b') THEN 'esbuild'
  WHEN contains(t, 'FuseBox.pkg(') OR contains(t, 'FuseBox.import(') OR contains(t, '$fsx.r(') OR contains(t, '$fsx.m(') THEN 'fusebox'
  WHEN regexp_matches(t, '\bfunction\s+o\s*\(') AND regexp_matches(t, '\bMODULE_NOT_FOUND\b') THEN 'browserify'
  WHEN contains(t, 'Cannot find module') AND regexp_matches(t, '\bMODULE_NOT_FOUND\b')
    AND NOT regexp_matches(t, '__webpack_require__|__webpack_modules__|__webpack_module_cache__|webpackChunk|webpackJsonp|loaded\s*:\s*!1|\bl\s*:\s*!1|Symbol\.toStringTag')
    AND NOT regexp_matches(t, 'parcelRequire|isParcelRequire|@parcel/runtime-js|newRequire\.(Module|modules|cache|parent|register)')
    AND NOT regexp_matches(t, '\b__vitePreload|import\.meta\.env|modulepreload|commonjsGlobal|getAugmentedNamespace|typeof\s+globalThis')
    AND NOT regexp_matches(t, '__commonJS|__toModule|__markAsModule|__toCommonJS|__exportStar|__create|__defProp|__getOwnPropDesc|__getOwnPropNames|__getProtoOf|__reExport|__require|__esm|__export|FuseBox\.pkg\(|FuseBox\.import\(|\$fsx\.[rm]\(|function\s+o\s*\(') THEN 'browserify_like'
  ELSE 'unknown' END"""


@query("case_bundle_classify", f"SELECT page_id, {_BUNDLE} AS bundle FROM (SELECT page_id, {_SCRIPT} AS t FROM pages) x")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(_SCRIPT).alias("t")).select("page_id", bundler(F.col("t")).alias("bundle"))


@query("case_dominance", "SELECT hash, CASE WHEN tp > fp THEN 'third' ELSE 'first' END AS party FROM (SELECT hash, count(*) FILTER (first_party_script) AS fp, count(*) FILTER (NOT first_party_script) AS tp FROM mem GROUP BY hash) x")
def _(s, d):
    f = F.col("first_party_script")
    return view(s, d, "mem").groupBy("hash").agg(F.count_if(f).alias("fp"), F.count_if(~f).alias("tp")).select("hash", dominance(F.col("fp"), F.col("tp")).alias("party"))


@query("flag_entropy", "SELECT event_ordinal, CASE WHEN value IS NOT NULL AND length(value) >= 8 THEN true END AS valid_entropy FROM ck")
def _(s, d):
    return view(s, d, "ck").select("event_ordinal", entropy_flag(F.col("value")).alias("valid_entropy"))


@query(
    "flag_expiry",
    """SELECT event_ordinal, CASE WHEN life >= 90 * 86400 THEN true END AS ge_interval, CASE WHEN floor(life / 86400) > 90 THEN true END AS gt_whole_days
    FROM (SELECT event_ordinal, floor(lifetime_days * 86400) AS life FROM ck) x""",
)
def _(s, d):
    seen = F.timestamp_seconds(F.lit(0))
    expiry = F.timestamp_seconds(F.floor(F.col("lifetime_days") * 86400))
    return view(s, d, "ck").select("event_ordinal", expiry_flag(expiry, seen).alias("ge_interval"), expiry_flag(expiry, seen, mode="gt_whole_days").alias("gt_whole_days"))


@query("flag_resource", "SELECT request_id, lower(headers) LIKE '%javascript%' AS is_javascript, lower(headers) LIKE '%set-cookie%' AS is_setcookie, lower(headers) LIKE '%websocket%' AS is_websocket FROM res")
def _(s, d):
    return view(s, d, "res").select("request_id", *resource_flags(F.col("headers")))


@query("flag_profile_code", "SELECT browser_id, CASE browser_id WHEN 'click' THEN 'EU1' WHEN 'error' THEN 'EU2' WHEN 'purchase' THEN 'US1' WHEN 'signup' THEN 'US2' END AS code, count(*) AS n FROM req GROUP BY ALL")
def _(s, d):
    return view(s, d, "req").groupBy("browser_id", profile_code(F.col("browser_id"), PROFILE_CODES).alias("code")).agg(F.count("*").alias("n"))


@query("flag_keyword", "SELECT url, url LIKE '%google%' AS is_google FROM mem WHERE url IS NOT NULL AND first_party_script IS NOT NULL")
def _(s, d):
    return view(s, d, "mem").dropna(subset=["url", "first_party_script"]).select("url", F.col("url").contains("google").alias("is_google"))
