"""URL functions as column expressions; malformed input gives null or an empty list, never an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
#: A small built-in part of the public suffix list; pass the full list (:func:`tidegauge.sources.readers.public_suffixes`) where it matters.
SUFFIXES = "com net org edu gov mil int info biz io dev app de fr es it nl be at ch eu us ca jp cn br uk co.uk org.uk ac.uk gov.uk au com.au net.au com.br co.jp or.jp *.ck !www.ck".split()


def ensure_scheme(url: Column) -> Column:
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("http://"), url))


def host(url: Column) -> Column:
    """Lower-cased host without user and port; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(ensure_scheme(url), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def registrable_domain(hosts: DataFrame, col: str, suffixes: Iterable[str] | DataFrame = SUFFIXES) -> DataFrame:
    """Distinct hosts with ``suffix`` and ``domain`` (one label more than the longest public suffix).

    Wildcard and exception rules hold; a host that is a suffix itself or an address has no domain; without a
    rule the last label is the suffix. The host's own endings are looked up, so no host meets all rules. ``suffixes``
    are texts or a frame (rule).
    """
    rules = suffixes if isinstance(suffixes, DataFrame) else hosts.sparkSession.createDataFrame([(r,) for r in suffixes], "rule string")
    rules = rules.select(F.regexp_replace("rule", r"^[!*]?\.?", "").alias("ending"), F.regexp_extract("rule", "^[!*]?", 0).alias("kind"))
    h = hosts.select(col).distinct().filter(F.col(col).isNotNull())
    labels = F.split(col, r"\.")
    n = F.size(labels)
    endings = h.select(col, labels.alias("l"), n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    endings = endings.withColumn("ending", F.array_join(F.slice("l", F.col("n") - F.col("k") + 1, F.col("k")), "."))
    size = F.when(F.col("kind") == "!", F.col("k") - 1).when(F.col("kind") == "*", F.col("k") + 1).otherwise(F.col("k"))
    best = endings.join(rules, "ending").groupBy(col).agg(F.max_by(size, F.struct(F.col("kind") == "!", size)).alias("_s"))
    out = h.join(best, col, "left").withColumn("_l", F.split(col, r"\.")).withColumn("_s", F.coalesce("_s", F.lit(1)))
    address = F.col(col).rlike(r"^[0-9.]+$|^\[")
    tail = lambda k: F.array_join(F.slice("_l", F.size("_l") - k + 1, k), ".")
    fits = ~address & (F.size("_l") > F.col("_s"))
    return out.select(col, F.when(~address & (F.size("_l") >= F.col("_s")), tail(F.col("_s"))).alias("suffix"), F.when(fits, tail(F.col("_s") + 1)).alias("domain"))


def first_party(a: Column, b: Column, coalesce: bool = True) -> Column:
    """Equal registrable domains; unknown counts as third party unless ``coalesce`` is off."""
    same = F.lower(a) == F.lower(b)
    return F.coalesce(same, F.lit(False)) if coalesce else same


def query_string(url: Column) -> Column:
    """What stands between the first ``?`` and the fragment."""
    return F.regexp_extract(F.regexp_extract(url, r"^[^#]*", 0), r"\?(.*)$", 1)


def decode(text: Column, plus: bool = True) -> Column:
    """Percent-decoding that keeps text which isn't valid; ``plus`` turns + into a blank."""
    t = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(t), text)


def query_keys(url: Column, keep_blank: bool = False) -> Column:
    """Decoded keys of the query string, sorted and distinct; parameters without a value are left out unless ``keep_blank``."""
    parts = F.split(query_string(F.coalesce(url, F.lit(""))), "&")
    kept = F.filter(parts, lambda p: (p != "") if keep_blank else p.rlike("(?s)^[^=]*=."))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: decode(F.substring_index(p, "=", 1)))))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def path_segments(url: Column) -> Column:
    """``/segment`` for each part of the path, then the first one again: it counts twice in the statistics."""
    s = F.transform(F.filter(F.split(path(F.coalesce(url, F.lit(""))), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))
    return F.when(F.size(s) > 0, F.array_append(s, s[0])).otherwise(s)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def is_encoded(text: Column) -> Column:
    """True when percent-decoding changes the text (+ is kept)."""
    return decode(text, plus=False) != text


def strip_data(url: Column) -> Column:
    """``data:`` URLs without their payload."""
    return F.when(F.lower(url).startswith("data:"), F.concat(F.regexp_extract(url, r"^[^,]*", 0), F.lit(",<data-stripped>"))).otherwise(url)


#: File extensions that aren't pages.
NOT_PAGES = "pdf jpg jpeg png gif svg webp zip gz exe dmg mp3 mp4 avi doc docx xls xlsx ppt pptx css js ico xml".split()


def subpages(pages: DataFrame, key: str, url: str, html: str, most: int = 25) -> DataFrame:
    """Up to ``most`` links of each page to other pages of its host: http(s) or relative, no anchors, mail, phone or script links, no files; once per path and query.

    The links of one page are an array of that page, so nothing is gathered beyond a page.
    """
    hrefs = F.regexp_extract_all(html, F.lit(r"<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))
    base = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*", 0)
    full = F.transform(hrefs, lambda h: F.when(h.rlike(r"^https?://"), h).when(h.startswith("/"), F.concat(base, h)))
    own = F.filter(full, lambda h: h.isNotNull() & (F.substring_index(h, "#", 1) != "") & (h.startswith(F.concat(base, F.lit("/")))) & ~F.lower(F.regexp_extract(h, r"^[^?#]*", 0)).rlike(rf"\.({'|'.join(NOT_PAGES)})$"))
    once = F.slice(F.array_distinct(F.transform(own, lambda h: F.substring_index(h, "#", 1))), 1, most)
    return pages.select(key, F.posexplode(once).alias("nth", "link"))
