"""Round trips through every source and sink, in the shared checkpoint folder."""

from __future__ import annotations

import re
import sqlite3
import uuid
from contextlib import closing
from functools import partial

from pyspark.sql import functions as F

from tidegauge.operators.joins import domain_variants
from tidegauge.operators.overview import count_by
from tidegauge.plans.checkpoints import shared_folder
from tidegauge.plans.views import view
from tidegauge.registry import query, table
from tidegauge.sources import readers as R
from tidegauge.sources import writers as W
from tidegauge.sources.leveldb_format import log_of


def folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


_CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_mktsegment string"


def _customers(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("src_parquet_local", _CUSTOMER)
def _(s, d):
    return R.parquet(s, f"{d}/customer.parquet", ["c_custkey", "c_name", "c_mktsegment"])


@query("sink_parquet", _CUSTOMER)
def _(s, d):
    W.parquet(_customers(s, d), at := folder(s), by=["c_mktsegment"])
    return s.read.schema(_SCHEMA).parquet(at)


@query("src_csv_chunked", _CUSTOMER)
def _(s, d):
    W.csv(_customers(s, d), at := folder(s))
    return R.csv(s, at, _SCHEMA)


@query("src_csv_usecols_dtypes", "SELECT c_custkey, c_mktsegment FROM customer")
def _(s, d):
    W.csv(_customers(s, d), at := folder(s))
    return R.csv(s, at, _SCHEMA, ["c_custkey", "c_mktsegment"])


@query("src_ndjson", _CUSTOMER)
def _(s, d):
    W.ndjson(_customers(s, d), at := folder(s))
    return R.ndjson(s, at, _SCHEMA)


@query("sink_ndjson_split", "SELECT count(*) AS n, true AS split, true AS bounded FROM customer")
def _(s, d):
    W.ndjson(_customers(s, d).repartition(3), at := folder(s), rows_per_file=100)
    per = R.ndjson(s, at, _SCHEMA).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n"), (F.count("*") >= F.ceil(F.sum("k") / 100)).alias("split"), (F.max("k") <= 100).alias("bounded"))


@query("src_json_nested_flatten", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(s, d):
    rows = F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    # a file for each hundred customers
    one = _customers(s, d).groupBy(F.floor(F.col("c_custkey") / 100).alias("k")).agg(F.to_json(F.array(F.struct(rows.alias("results")))).alias("value"))
    at = folder(s)
    one.repartition("k").write.partitionBy("k").text(at)
    return R.nested_results(s, at, "id bigint, name string")


@query("sink_blob", "SELECT count(DISTINCT md5(html)) AS n FROM pages")
def _(s, d):
    b = table(s, d, "pages").select(F.md5(F.col("html").cast("binary")).alias("content_hash"), F.col("html").cast("binary").alias("content"))
    at = folder(s)
    W.blobs(b, at)
    W.blobs(b, at)  # a second time adds nothing
    return s.read.parquet(at).agg(F.count("*").alias("n"))


@query("src_rules_text", "SELECT 'r' || (n_nationkey % 2) AS list, '||' || lower(n_name) || '.com^' AS value FROM nation")
def _(s, d):
    at = folder(s)
    rules = table(s, d, "nation").select((F.col("n_nationkey") % 2).alias("k"), F.concat(F.lit("||"), F.lower("n_name"), F.lit(".com^")).alias("value")).collect()  # 25 rows
    for k in (0, 1):
        W.put(s, f"{at}/r{k}.txt", "\n".join(["! comment", "", *(f"  {r.value}" for r in rules if r.k == k)]).encode())
    return R.rules_text(s, at)


@query("src_hosts_file", "SELECT lower(replace(n_name, ' ', '-')) || '.com' AS domain FROM nation")
def _(s, d):
    line = F.concat(F.lit("0.0.0.0 "), F.regexp_replace("n_name", " ", "-"), F.lit(".com # x"))
    W.report(table(s, d, "nation").select(line.alias("value")), at := folder(s))
    return R.hosts_file(s, at)


@query("src_dir_listing_size", "SELECT n_regionkey::VARCHAR AS folder, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation GROUP BY n_regionkey")
def _(s, d):
    at = folder(s)
    table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(at)
    return R.listing(s, at).select(F.regexp_replace("folder", "k=", "").alias("folder"), "bytes")


@query("src_profile_from_filename", "SELECT n_nationkey, ['EU1', 'EU2', 'US1', 'US2', NULL][n_nationkey % 5 + 1] AS profile FROM nation")
def _(s, d):
    at = folder(s)
    names = ["sizes-EU1.csv", "x.EU2.csv", "US1.csv", "a-US2-b.csv", "EU12.csv"]
    rows = table(s, d, "nation").select("n_nationkey").collect()  # 25 rows
    for k, name in enumerate(names):
        W.put(s, f"{at}/{name}", "\n".join(["n_nationkey", *(str(r.n_nationkey) for r in rows if r.n_nationkey % 5 == k)]).encode())
    return R.csv(s, at, "n_nationkey int").select("n_nationkey", R.profile_of_file(F.col("_metadata.file_name")).alias("profile"))


@query("src_sqlite_tables", "SELECT n_nationkey AS visit_id, n_name AS site_url, NULL::BIGINT AS site_rank, 'site' || n_regionkey || '.sqlite' AS file FROM nation")
def _(s, d):
    at = folder(s)
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows, a file for each region
    for region in {r.n_regionkey for r in rows}:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE site_visits (visit_id INTEGER, site_url TEXT)")
        db.executemany("INSERT INTO site_visits VALUES (?, ?)", [(r.n_nationkey, r.n_name) for r in rows if r.n_regionkey == region])
        db.commit()
        W.put(s, f"{at}/site{region}.sqlite", db.serialize())
        db.close()
    out = R.sqlite_tables(s, at, "site_visits", "visit_id int, site_url string, site_rank long")
    return out.select("visit_id", "site_url", "site_rank", F.regexp_extract("source_file", "[^/]+$", 0).alias("file"))


@query("src_leveldb_content", "SELECT md5(n_name) AS content_hash, n_name AS content FROM nation WHERE n_nationkey <> 3")
def _(s, d):
    at = folder(s)
    rows = table(s, d, "nation").select(F.md5(F.col("n_name").cast("binary")).alias("h"), "n_name", "n_nationkey").collect()  # 25 rows
    writes = [(r.h.encode(), r.n_name.encode()) for r in rows]
    W.put(s, f"{at}/000003.log", log_of(1, [(k, b"older") for k, _ in writes]))
    W.put(s, f"{at}/000005.log", log_of(100, [*writes, *((r.h.encode(), None) for r in rows if r.n_nationkey == 3)]))
    return R.leveldb_content(s, at).withColumn("content", F.col("content").cast("string"))


def _database(s):
    """Connections to a database file in the shared folder, which any process may open; on a cluster without a shared disk pass those of a server."""
    at = folder(s)
    W.put(s, f"{at}/customers.sqlite", b"")
    connect = partial(sqlite3.connect, re.sub("^file:/*", "/", at) + "/customers.sqlite", timeout=3600)
    with closing(connect()) as db:
        db.execute("CREATE TABLE customers (c_custkey INTEGER, c_name TEXT, c_mktsegment TEXT)")
        db.execute("CREATE TABLE customers_parts (run TEXT, part INTEGER, PRIMARY KEY (run, part))")
        db.commit()
    return connect


@query("sink_rdbms_bulk", _CUSTOMER)
def _(s, d):
    connect = _database(s)
    W.dbapi(_customers(s, d), connect, "customers")
    return R.dbapi(s, connect, "customers", _SCHEMA, partition=("c_custkey", 4))


@query("src_cursor_batched", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(s, d):
    connect = _database(s)
    W.dbapi(_customers(s, d), connect, "customers")
    return count_by(R.dbapi(s, connect, "customers", _SCHEMA, partition=("c_custkey", 4), fetch=500), "c_mktsegment")


@query("sink_text_report", "SELECT n_nationkey || ': ' || n_name AS value FROM nation")
def _(s, d):
    W.report(table(s, d, "nation").select(F.concat_ws(": ", "n_nationkey", "n_name").alias("value")), at := folder(s))
    return s.read.text(at)


@query("sink_json_per_folder", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(s, d):
    at = folder(s)
    W.json_folders(_customers(s, d), at, ["c_mktsegment"])
    return count_by(s.read.schema(_SCHEMA).json(at), "c_mktsegment")


@query("sink_warehouse_stream", "SELECT c_custkey, 'ValueError: refused' AS error FROM customer WHERE c_custkey % 50 = 0")
def _(s, d):
    at = folder(s)
    _customers(s, d).write.parquet(f"{at}/in")

    def send(batch):
        seen = globals().setdefault("_tried", set())  # of a worker: a target that is busy the first time
        first = (batch[0]["c_custkey"], len(batch))
        if first not in seen:
            seen.add(first)
            raise OSError("busy")
        if any(r["c_custkey"] % 50 == 0 for r in batch):
            raise ValueError("refused")

    def insert(batch, epoch):
        # a file may be one task: its rows are sent by all cores
        W.in_batches(batch.repartition(s.sparkContext.defaultParallelism), send, rows=100, tries=2, wait=0.01).write.mode("overwrite").parquet(f"{at}/dead/epoch={epoch}")

    stream = s.readStream.schema(_SCHEMA).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(insert).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    dead = s.read.schema("record string, error string").parquet(f"{at}/dead")
    return dead.select(F.get_json_object("record", "$.c_custkey").cast("bigint").alias("c_custkey"), "error")


@query("ddl_ctas", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    name = f"t_{uuid.uuid4().hex}"
    W.table(table(s, d, "region").select("r_regionkey", "r_name"), name, ["r_regionkey"])
    return s.table(name)


@query("ddl_add_column", "SELECT r_regionkey, r_name, NULL::VARCHAR AS bundle FROM region")
def _(s, d):
    return W.add_column(table(s, d, "region").select("r_regionkey", "r_name"), "bundle", "string")


@query("meta_table_size")
def _(s, d):
    return s.createDataFrame([("region", W.size_of(table(s, d, "region")))], "name string, bytes long")


@query("param_sql_script", "SELECT slot, p.least AS least, count(*) AS n FROM mem JOIN (VALUES ('cluster_1', 10), ('cluster_2', 20)) p(slot, least) USING (slot) WHERE site_id >= p.least GROUP BY ALL")
def _(s, d):
    params = s.createDataFrame([("cluster_1", 10), ("cluster_2", 20)], "slot string, least int")
    return W.from_params(view(s, d, "mem"), params, ["slot"], lambda x: x.filter("site_id >= least").groupBy("slot", "least").agg(F.count("*").alias("n")))


@query("url_domain_variants", "SELECT DISTINCT host, host AS v FROM ck UNION SELECT DISTINCT host, regexp_extract(host, '\\.(.+)$', 1) FROM ck UNION SELECT DISTINCT host, 'com' FROM ck")
def _(s, d):
    h = view(s, d, "ck").select("host").distinct()
    return h.select("host", F.explode(domain_variants(F.col("host"))).alias("v"))
