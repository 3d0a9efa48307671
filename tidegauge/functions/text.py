"""Strings, dates, numbers, JSON and HTTP headers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def cookie_name(pair: Column, trim: bool = False) -> Column:
    """What stands before the first ``=``; without one, the empty string. The leading blank of later pairs stays unless ``trim``."""
    p = F.trim(pair) if trim else pair
    return F.replace(F.substring(p, F.lit(1), F.instr(p, "=")), F.lit("="), F.lit(""))


def cookie_names(value: Column, trim: bool = False) -> Column:
    return F.transform(F.split(value, ";"), lambda p: cookie_name(p, trim))


def clean_prefix(name: Column, prefixes: Sequence[str]) -> Column:
    """The longest known prefix that the name starts with, else the name."""
    out = name
    for p in sorted(prefixes, key=lambda p: (len(p), p)):
        out = F.when(name.startswith(p), p).otherwise(out)
    return out


def list_cell(text: Column) -> Column:
    """``[a, b, ]`` as an array of its trimmed non-empty parts, without quotes."""
    parts = F.transform(F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"^\s*['\"]|['\"]\s*$", "")))
    return F.filter(parts, lambda x: x != "")


def as_bool(text: Column, yes: Sequence[str] = ("true", "1", "yes")) -> Column:
    """Whether the lower-cased text is one of the words; null counts as false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*yes), F.lit(False))


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def repair_script_fields(url: Column, line: Column, col: Column, func: Column) -> list[Column]:
    """script_url, script_line, script_col, func_name and repaired: a URL that was split over the fields behind it is put together.

    Without a URL, line and column are its two halves where both are there, else function and column where those are and
    the line isn't; the fields that the URL came from become empty. Null counts as empty; all else stays as it is.
    """
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    by_line = empty(url) & ~empty(line) & ~empty(col)
    by_func = empty(url) & empty(line) & ~empty(col) & ~empty(func)
    return [
        F.when(by_line, F.concat(line, col)).when(by_func, F.concat(func, col)).otherwise(url).alias("script_url"),
        F.when(by_line, "").otherwise(line).alias("script_line"),
        F.when(by_line | by_func, "").otherwise(col).alias("script_col"),
        F.when(by_func, "").otherwise(func).alias("func_name"),
        (by_line | by_func).alias("repaired"),
    ]


def drop_tokens(text: Column, stop: Sequence[str]) -> Column:
    """Lower-cased words without the stop words, repeats kept."""
    w = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " "), " "), lambda x: x != "")
    return F.filter(w, lambda x: ~x.isin(*stop))


def ngrams(text: Column, width: int) -> Column:
    """Character n-grams; a shorter text is its only gram. The text is cut into characters once, so the time grows with the text."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def grams(c: Column) -> Column:
        n = F.greatest(F.size(c) - width + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*(F.coalesce(F.get(c, i + k), F.lit("")) for k in range(width))))

    # by way of an array of one, so that the characters are cut once and not for every gram
    return F.transform(F.array(chars), grams)[0]


def shift(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def parse_time(text: Column, hours: int = 2, sentinel: str = "9999-12-31 23:59:59") -> Column:
    """ISO time (a trailing Z is dropped) plus the shift; what can't be parsed is the sentinel."""
    t = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))
    return F.coalesce(shift(t, hours), F.to_timestamp(F.lit(sentinel)))


def chrome_time(micros: Column, hours: int = 2) -> Column:
    """Microseconds since 1601 as a timestamp, shifted and clamped to the last second of 9998."""
    return shift(F.timestamp_micros(F.least(micros, F.lit(265000000000000000)) - 11644473600000000), hours)


#: Day, month and year parts of HTTP dates, weekday and zone removed, in the order they are tried.
COOKIE_DATES = ["dd-MMM-yyyy HH:mm:ss", "dd MMM yyyy HH:mm:ss", "dd-MMM-yy HH:mm:ss", "dd MMM yy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd MM yyyy HH:mm:ss", "dd-MM-yy HH:mm:ss", "dd MM yy HH:mm:ss"]


def cookie_date(text: Column) -> Column:
    """Expiry of a Set-Cookie header: the first format that parses, years from 1900 on; else null."""
    bare = F.regexp_extract(text, r"^[A-Za-z]{3},\s+(.*?)\s+[A-Za-z]+$", 1)
    t = F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in COOKIE_DATES))
    return F.when(F.year(t) >= 1900, t)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unhex64(text: Column) -> Column:
    """A hash written in hexadecimal (with or without 0x) or decimal, as the 64-bit pattern."""
    h = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(F.trim(text).rlike("(?i)^(0x)?[0-9a-f]{1,16}$"), F.conv(h, 16, -10).cast("bigint")).otherwise(F.conv(text, 10, -10).cast("bigint"))


def header(headers: Column, name: str) -> Column:
    """First value of a header in ``[[name, value], ...]`` JSON, whatever its case."""
    pairs = F.from_json(headers, "array<array<string>>")
    return F.get(F.filter(pairs, lambda p: F.lower(p[0]) == name.lower()), F.lit(0))[1]


def request_cookies(value: Column) -> Column:
    """``a=1; b=2`` as an array of (name, value)."""
    parts = F.filter(F.split(value, r";\s*"), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.expr("1").cast("string").alias("value")).withField("value", F.substring(p, F.instr(p, "=") + 1, F.length(p))))


def response_cookie(value: Column, url: Column) -> list[Column]:
    """name, value, domain, path, expires, max_age, http_only and secure of one Set-Cookie header, with a browser's defaults."""
    first = F.substring_index(value, ";", 1)
    attr = lambda k: F.nullif(F.regexp_extract(value, rf"(?i);\s*{k}\s*=\s*\"?([^;\"]*)", 1), F.lit(""))
    flag = lambda k: value.rlike(rf"(?i);\s*{k}\s*(;|$)")
    given = attr("domain")
    parent = F.regexp_extract(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), r"^(.*)/[^/]*$", 1)
    return [
        F.trim(F.substring_index(first, "=", 1)).alias("name"),
        F.substring(first, F.instr(first, "=") + 1, F.length(first)).alias("value"),
        F.coalesce(F.when(given.startswith("."), given).otherwise(F.concat(F.lit("."), given)), F.regexp_extract(url, r"://([^/?#:]*)", 1)).alias("domain"),
        F.coalesce(attr("path"), F.when(parent == "", "/").otherwise(parent)).alias("path"),
        cookie_date(attr("expires")).alias("expires"),
        attr("max-age").alias("max_age"),
        flag("httponly").alias("http_only"),
        flag("secure").alias("secure"),
    ]


def category_probe(html: Column, needles: Sequence[tuple[str, str]]) -> Column:
    """Label of the last listed needle that the page holds, else null."""
    out = F.lit(None).cast("string")
    for needle, label in needles:
        out = F.when(html.contains(needle), label).otherwise(out)
    return out


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts (null counts as empty), with the standard library's matcher."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def length_ok(a: Column, b: Column, most: float = 0.25) -> Column:
    """Lengths differ by at most the share of the longer; two empty texts pass, one empty text doesn't."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) & (m == 0), True).when((n == 0) | (m == 0), False).otherwise(F.abs(n - m) / F.greatest(n, m) <= most)


def crawl_state(status: Column, started: Column, duration_ms: Column, hours: int = 2) -> list[Column]:
    """state, timeout, start and finish of a page visit from its command's status: ok and timeout count as crawled (1), anything else as failed (-1)."""
    start = shift(started, hours)
    finish = F.timestamp_micros(F.unix_micros(start) + duration_ms.cast("bigint") * 1000)
    return [F.when(status.isin("ok", "timeout"), 1).otherwise(-1).alias("state"), F.coalesce(status == "timeout", F.lit(False)).cast("int").alias("timeout"), start.alias("start"), finish.alias("finish")]


# The operations that a script call record may name.
OPERATIONS = ["call", "get", "get(failed)", "get(function)", "set", "set(failed)", "set(prevented)"]


def known_operation(operation: Column) -> Column:
    return F.coalesce(operation.isin(*OPERATIONS), F.lit(False))


def record_type(removed: Column, snapshot: Column | None = None) -> Column:
    """``deleted`` for a cookie that was removed, else ``added-or-changed``; ``manual-export`` for records of a snapshot of the whole jar."""
    kind = F.when(F.coalesce(removed, F.lit(False)), "deleted").otherwise("added-or-changed")
    return kind if snapshot is None else F.when(F.coalesce(snapshot, F.lit(False)), "manual-export").otherwise(kind)


def post_body(body: Column, kind: Column) -> list[Column]:
    """post_body and post_body_raw of a request: form data as a JSON object of the lists of each field's values, anything else as ``[[file, base64 of the bytes]]`` with the file null.

    ``body`` is binary, ``kind`` the content type; one of the two is null, both where there is no body. Fields are ordered by name.
    """
    text = body.cast("string")
    pairs = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p: F.struct(_form(F.substring_index(p, "=", 1)).alias("k"), _form(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
    form = F.coalesce(F.lower(kind).contains("application/x-www-form-urlencoded"), F.lit(False))
    raw = F.to_json(F.array(F.array(F.lit(None).cast("string"), F.base64(body))))
    return [F.when(body.isNotNull() & form, F.to_json(fields)).alias("post_body"), F.when(body.isNotNull() & ~form, raw).alias("post_body_raw")]


def _form(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def coerce(value: Column, kind: str) -> Column:
    """What a store of texts takes: ``bytes`` as UTF-8 without what isn't valid, ``record`` (a struct, map or array) as JSON, ``function`` and others as text."""
    if kind == "bytes":
        return _valid_utf8(value)
    return F.to_json(value) if kind == "record" else value.cast("string")


@F.pandas_udf(StringType())
def _valid_utf8(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else bytes(v).decode("utf-8", "ignore") for v in value], dtype=object)


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id that is the same for the same parts, whatever run or machine makes it (null parts count as a mark of their own)."""
    h = F.md5(F.to_json(F.struct(*(p.cast("string").alias(f"c{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
