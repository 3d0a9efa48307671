"""Study-shaped views over the input tables.

Each is one SQL text that Spark and DuckDB both read; :func:`view` plans it over the Parquet tables (column
pruning and filters reach the scans), and :func:`with_views` puts the texts in front of an oracle statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # HTTP requests: events dealt over the pages
    "req": """SELECT e.event_id AS request_id, e.event_type AS browser_id, e.user_id AS site_id, day(e.ts) AS subpage_id,
  concat(cast(e.user_id AS string), '_', cast(day(e.ts) AS string)) AS visit_id, p.page_id, p.url,
  concat('https://site', cast(e.user_id % 30 AS string), '.example.', CASE WHEN e.user_id % 2 = 0 THEN 'com' ELSE 'org' END, '/') AS top_level_url,
  e.value > 20 AS is_tracker, e.ts AS time_stamp
FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = e.event_id % c.n""",
    # their responses
    "res": """SELECT request_id, browser_id, visit_id, site_id, url AS response_url,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE md5(concat('script', cast(page_id % 60 AS string))) END AS content_hash,
  CASE WHEN request_id % 3 = 0 THEN '[["Content-Type","text/javascript"],["Set-Cookie","sid=1; Path=/"]]'
       WHEN request_id % 3 = 1 THEN '[["content-type","text/html"],["Upgrade","websocket"]]' ELSE '[["X-Cache","HIT"]]' END AS headers
FROM req WHERE request_id % 11 <> 5""",
    # cookie records with three-valued flags
    "ck": """SELECT event_id AS event_ordinal, event_type AS browser_id, user_id AS site_id,
  concat(cast(user_id AS string), '_', cast(day(ts) AS string)) AS visit_id,
  concat('ck_', cast(k % 40 AS string)) AS name, concat('d', cast(k % 25 AS string), '.example.com') AS host,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'short' WHEN k % 11 = 0 THEN '[a:1]' WHEN k % 13 = 0 THEN '{"x":2}' ELSE md5(concat(cast(k AS string), '_', cast(user_id AS string))) END AS value,
  CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 = 0 END AS first_party_cookie, value AS lifetime_days, ts AS time_stamp
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events) t""",
    # script calls: some cookie records lack one, some have two
    "js": """SELECT event_ordinal AS page_scoped_event_ordinal, browser_id, visit_id, site_id, 0 AS copy,
  concat('https://cdn', cast(event_ordinal % 50 AS string), '.example.', CASE WHEN event_ordinal % 3 = 0 THEN 'net' ELSE 'com' END, '/s', cast(event_ordinal % 20 AS string), '.js') AS script_url,
  CASE WHEN event_ordinal % 4 = 0 THEN 'set' WHEN event_ordinal % 4 = 1 THEN 'get' WHEN event_ordinal % 4 = 2 THEN 'call' ELSE 'get(failed)' END AS operation,
  CASE WHEN event_ordinal % 5 = 0 THEN 'window.navigator' ELSE 'window.document.cookie' END AS symbol,
  CASE WHEN event_ordinal % 17 = 0 THEN '' ELSE concat(name, '=', coalesce(value, ''), '; b=', cast(event_ordinal % 3 AS string)) END AS value,
  CASE WHEN event_ordinal % 6 = 0 THEN ' 12 ' WHEN event_ordinal % 6 = 1 THEN 'x' ELSE cast(event_ordinal % 300 AS string) END AS script_line
FROM ck WHERE event_ordinal % 10 <> 3
UNION ALL
SELECT event_ordinal, browser_id, visit_id, site_id, 1, concat('https://cdn', cast(event_ordinal % 50 AS string), '.example.com/dup.js'), 'set', 'window.document.cookie', concat(name, '=', coalesce(value, '')), '7'
FROM ck WHERE event_ordinal % 10 = 7""",
    # distinct (cluster, item): order keys and the brands bought
    "bk": "SELECT DISTINCT l_orderkey AS cluster_id, p_brand AS cookie FROM lineitem JOIN part ON l_partkey = p_partkey",
    # clusters of scripts: suppliers as clusters, parts as member slots
    "mem": """SELECT l_suppkey AS cluster, concat('h', cast(l_partkey AS string)) AS hash, concat('cluster_', cast(l_partkey % 7 AS string)) AS slot,
  l_orderkey % 40 AS site_id, concat(cast(l_orderkey % 40 AS string), '_', cast(l_linenumber AS string)) AS visit_id, l_returnflag AS profile,
  CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity > 30 END AS first_party_script,
  concat('https://s', cast(l_partkey % 90 AS string), CASE WHEN l_partkey % 4 = 0 THEN '.google.com' ELSE '.example.net' END, '/x.js') AS url, concat('ck_', cast(l_partkey % 40 AS string)) AS cookie_name
FROM lineitem""",
    # labelled URLs
    "lab": "SELECT p.page_id, p.url, p.html, coalesce(l.toxic, p.page_id % 2) = 1 AS positive FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id",
    # URLs judged by three lists
    "cls": """SELECT url, page_id % 3 = 0 AS easylist, page_id % 5 < 2 AS easyprivacy, url LIKE '%utm_source%' OR page_id % 7 = 0 AS custom FROM pages""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """The statement with the views that it reads in front, as common table expressions."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _needed(sql, []))
    if not views:
        return sql
    return f"WITH {views}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {views} {sql}"


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the views and input tables."""
    text = with_views(sql)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views."""
    return select(spark, sf_dir, f"SELECT * FROM {name}")
