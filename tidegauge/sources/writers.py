"""Writers. All go through Spark's commit protocol, so a lost executor or a second attempt leaves no half files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from itertools import islice
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def ndjson(df: DataFrame, path: str, rows_per_file: int = 100_000, mode: str = "append") -> None:
    """JSON lines, at most ``rows_per_file`` a file."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path)


def json_folders(df: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    """JSON lines in a folder for each value of the columns, which the folder names hold and the lines don't."""
    df.write.mode(mode).partitionBy(*by).json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).option("header", True).csv(path)


def report(lines: DataFrame, path: str, column: str = "value") -> None:
    """A text report of one column; a sorted frame keeps its order over the numbered files."""
    lines.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def blobs(df: DataFrame, path: str) -> None:
    """Append blobs (content_hash, content) whose hash the store doesn't hold yet, gzip-compressed in Parquet, one of each hash."""
    spark = df.sparkSession
    one = df.groupBy("content_hash").agg(F.min("content").alias("content"))
    try:
        held = spark.read.parquet(path).select("content_hash")
    except Exception as e:  # an empty store has no schema yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        one = one.join(held, "content_hash", "left_anti")
    one.write.mode("append").option("compression", "gzip").parquet(path)


def jdbc(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    """Append to a database table in batches of rows."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def dbapi(df: DataFrame, connect: Callable[[], Any], table: str, batch: int = 500, mark: str = "?") -> None:
    """Append to a database table from the executors by DB-API connections, each partition in one transaction of batches.

    ``connect`` is called in the tasks and must lead all of them to the same database. The numbers of the partitions that are in are kept
    in ``<table>_parts``, in the same transactions, so a task that runs twice adds its rows once.
    """
    names = df.columns
    insert = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"
    run = uuid.uuid4().hex

    def part(it: Iterator[Row]) -> None:
        number = TaskContext.get().partitionId()
        with closing(connect()) as db:
            cursor = db.cursor()
            try:
                cursor.execute(f"INSERT INTO {table}_parts (run, part) VALUES ({mark}, {mark})", (run, number))
            except Exception:
                db.rollback()
                cursor.execute(f"SELECT count(*) FROM {table}_parts WHERE run = {mark} AND part = {mark}", (run, number))
                if cursor.fetchone()[0]:
                    return  # an earlier attempt has committed
                raise
            while rows := [tuple(r) for r in islice(it, batch)]:
                cursor.executemany(insert, rows)
            db.commit()

    df.foreachPartition(part)


def in_batches(df: DataFrame, send: Callable[[list[dict]], None], rows: int = 500, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Send rows in batches from the executors; what fails ``tries`` times is sent row by row, and the rows that still fail come back as (record, error).

    Use it in ``foreachBatch`` and append the result to a dead-letter table.
    """

    def attempt(batch: list[dict]) -> str | None:
        for k in range(tries):
            try:
                send(batch)
                return None
            except Exception as e:  # any error of the target: it's reported, not hidden
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:  # nothing is waited for after the last
                    time.sleep(wait * k)
        return error

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in it:
            failed = []
            for at in range(0, len(b), rows):
                records = [json.loads(r) for r in b["record"].iloc[at : at + rows]]
                if attempt(records) is not None:
                    failed += [(json.dumps(r), e) for r in records if (e := attempt([r])) is not None]
            yield pd.DataFrame(failed, columns=["record", "error"])

    return df.select(F.to_json(F.struct("*")).alias("record")).mapInPandas(part, "record string, error string")


def table(df: DataFrame, name: str, cluster_by: Sequence[str] = (), buckets: int = 0) -> None:
    """CREATE OR REPLACE TABLE ... CLUSTER BY: sorted within files, bucketed where joins should meet without a shuffle."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if buckets:
        df.write.bucketBy(buckets, *cluster_by).sortBy(*cluster_by).saveAsTable(name)
    else:
        (df.sortWithinPartitions(*cluster_by) if cluster_by else df).write.saveAsTable(name)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """ALTER TABLE ADD COLUMN: null until something sets it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def size_of(df: DataFrame, step: int = 10_000) -> int:
    """Bytes of the files that a frame reads, listed in steps of so many files."""
    files = df.inputFiles()
    parts = (files[i : i + step] for i in range(0, len(files), step))
    return sum(df.sparkSession.read.format("binaryFile").load(p).agg(F.sum("length")).first()[0] or 0 for p in parts)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file in any file system that Spark knows, overwritten if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(content)
    finally:
        out.close()


def from_params(df: DataFrame, params: DataFrame, on: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A scripted loop over constants as one join with a table of parameters."""
    return fn(df.join(params, list(on)))
