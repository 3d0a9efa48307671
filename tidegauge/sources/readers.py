"""Readers: every one takes a schema or has a fixed one, so nothing is inferred, and prunes by ``select``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.functions import text as T
from tidegauge.sources import leveldb_format


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A dataset folder, on any file system that Spark has a connector for (file, s3a, gs, ...)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str | StructType, columns: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; files are split among tasks, so there is no chunk size."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def ndjson(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.json(path, schema=schema)


def nested_results(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files of ``[{"results": [{...}, ...]}, ...]`` as rows of ``record`` (a DDL string); records that lack all its keys are left out."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<struct<results:array<struct<{record}>>>>")
    rows = whole.select(F.explode(items).alias("item")).select(F.inline("item.results"))
    return rows.dropna(how="all")


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 5000, **options: str) -> DataFrame:
    """A database table; ``partition`` is (column, low, high, parts) for a parallel read, ``fetch`` the rows per round trip."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if partition:
        column, low, high, parts = partition
        r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


def dbapi(spark: SparkSession, connect: Callable[[], Any], table: str, schema: str, partition: tuple[str, int] | None = None, fetch: int = 5000, mark: str = "?") -> DataFrame:
    """A database table by DB-API connections of the executors, ``fetch`` rows from a cursor at a time; ``partition`` is (column, parts) for a parallel read of ranges.

    ``connect`` is called in the tasks and must lead all of them to the same database; the driver asks for the ends of the column only.
    """
    names = StructType.fromDDL(schema).fieldNames()
    text = f"SELECT {', '.join(names)} FROM {table}"
    ranges: list[tuple[int | None, int | None]] = [(None, None)]
    if partition:
        column, parts = partition
        with closing(connect()) as db:
            cursor = db.cursor()
            cursor.execute(f"SELECT min({column}), max({column}) FROM {table}")
            low, high = cursor.fetchone()
        if low is not None:
            cuts = sorted({low + (high + 1 - low) * i // parts for i in range(1, parts)} - {low})
            ranges = list(zip([None, *cuts], [*cuts, None], strict=True))  # nulls go with the first

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for at in b["at"]:
                low, high = ranges[at]
                tests, values = [], []
                if low is not None:
                    tests, values = [f"{column} >= {mark}"], [low]
                if high is not None:
                    tests, values = [*tests, f"({column} < {mark}{f' OR {column} IS NULL' if low is None else ''})"], [*values, high]
                with closing(connect()) as db:
                    cursor = db.cursor()
                    cursor.execute(text + (f" WHERE {' AND '.join(tests)}" if tests else ""), values)
                    while rows := cursor.fetchmany(fetch):
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.range(0, len(ranges), 1, len(ranges)).toDF("at").mapInPandas(read, schema)


def sqlite_tables(spark: SparkSession, path: str, table: str, schema: str, visit_id: int | None = None) -> DataFrame:
    """One table out of many SQLite files, a file per task, with the file as ``source_file``.

    Files come through Spark's own reader, so they may be in any store; absent tables give no rows and absent
    columns nulls.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = StructType.fromDDL(schema)
    names = fields.fieldNames()

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in it:
            for where, content in zip(b["path"], b["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                have = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
                if not have:
                    continue
                cols = ", ".join(f'"{n}"' if n in have else f'NULL AS "{n}"' for n in names)
                cond, args = (" WHERE visit_id = ?", (visit_id,)) if visit_id is not None else ("", ())
                cursor = db.execute(f'SELECT {cols} FROM "{table}"{cond}', args)
                while rows := cursor.fetchmany(5000):
                    yield pd.DataFrame(rows, columns=names, dtype=object).assign(source_file=where)
                db.close()

    return files.mapInPandas(read, fields.add("source_file", "string"))


def rules_text(spark: SparkSession, path: str) -> DataFrame:
    """(list, value): the rules of filter lists without blanks and ``!`` comments; the list is the file's name."""
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("list"), F.trim("value").alias("value"))
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith("!"))


def hosts_file(spark: SparkSession, path: str) -> DataFrame:
    """(domain): the second word of hosts-file lines without comments."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    words = F.split(line, r"\s+")
    return spark.read.text(path).filter(line != "").select(F.lower(F.get(words, F.lit(1))).alias("domain")).dropna().distinct()


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, content) of a folder of blobs named by their hash; gzip content is unpacked."""

    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in it:
            yield pd.DataFrame({"content_hash": b["content_hash"], "content": [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in b["content"]]})

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("content_hash"), "content").mapInPandas(unpack, "content_hash string, content binary")


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(rule): the rules of a public suffix list file, with their ``*.`` and ``!``; comments and blank lines are left out."""
    rule = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).select(F.lower(rule).alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def leveldb(spark: SparkSession, path: str) -> DataFrame:
    """(key, value), both binary, of a LevelDB folder: the newest entry of every key, deleted keys left out.

    Table files (.ldb, .sst) and write logs (.log) are read by a task each, whole; every entry has a sequence number, so
    the newest is an aggregate by key and neither the order of the files nor the manifest matters. Blocks may be plain
    or compressed with Snappy.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.filter(F.col("path").rlike(r"\.(ldb|sst|log)$"))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for where, content in zip(b["path"], b["content"], strict=True):
                entries = leveldb_format.log_entries(bytes(content)) if where.endswith(".log") else leveldb_format.table_entries(bytes(content))
                while part := list(islice(entries, 1000)):
                    yield pd.DataFrame(part, columns=["key", "seq", "live", "value"])

    rows = files.mapInPandas(read, "key binary, seq long, live boolean, value binary")
    last = rows.groupBy("key").agg(F.max(F.struct("seq", "live", "value")).alias("l"))
    return last.filter("l.live").select("key", F.col("l.value").alias("value"))


def leveldb_content(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, content): a LevelDB store of contents by their hash."""
    return leveldb(spark, path).select(F.col("key").cast("string").alias("content_hash"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str, folders: DataFrame | None = None) -> DataFrame:
    """(folder, files, bytes) of a tree, without reading the files; folders of the list that hold none count 0."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "length")
    n = f.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return folders.join(n, "folder", "left").fillna(0, ["files", "bytes"]) if folders is not None else n


def profile_of_file(path: F.Column) -> F.Column:
    """EU1, EU2, US1 or US2 from a file's name."""
    return F.nullif(F.regexp_extract(path, r"(?:^|[^A-Za-z0-9_])((?:EU|US)[12])(?:[^A-Za-z0-9_]|$)", 1), F.lit(""))


def flags(df: DataFrame, *columns: str) -> DataFrame:
    """0/1, true/false texts or numbers as booleans; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), T.as_bool(F.col(c))) for c in columns})
