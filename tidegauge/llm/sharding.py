"""Sharding by weighted rendezvous hashing.

Each shard draws a number in (0, 1) from a hash of (record key, shard); the shard with the largest
``-weight / ln(u)`` takes the record. The choice for one shard does not depend on the others, so one
more shard only takes rows into itself, and a shard that goes only gives up its own rows.

Edge cases: a null key hashes as the empty string; a null text has size 1 and CRC 0; repeated rows
get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, query, table, text_of

#: Hex digits of the hash that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Rows of one shard that one task numbers.
SLOT_BLOCK = 50_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ..) of a key; ties go to the lower shard, shards of weight 0 or less take nothing."""
    scores = [F.struct((-w / F.log(draw(key, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight above 0")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def slots(df: DataFrame, group: str, spread: Column, order: Sequence[str], rows: int, block: int = SLOT_BLOCK) -> DataFrame:
    """Number the rows of each group gapless from 0 without gathering a group in one task.

    Rows are spread over blocks by a hash; each block is numbered by itself and shifted by the sizes of
    the blocks before it. Only the counts, one row for each group and block, meet in the offset window.
    """
    blocks = max(1, -(-rows // block))
    df = cut(df.withColumn("_block", F.pmod(spread, F.lit(blocks)).cast("int")))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    offsets = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(group, "_block").orderBy(*order)
    return df.join(offsets, [group, "_block"]).withColumn("slot", (F.row_number().over(own) - 1 + F.col("_shift")).cast("long")).drop("_shift", "_block")


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard of the mean weight) of every row."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = text_of(text).cast("binary")
    base = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    spread = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    out = slots(base, "shard", spread, ["doc_id", "text_crc32", "size"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _best(n: int) -> str:
    """DuckDB: the shard of ``key`` among n of equal weight."""
    each = ", ".join(f"{{'score': -1.0 / ln((('0x' || left(md5(key || '/{s}'), {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)}), 'shard': {-s}}}" for s in range(n))
    return f"(-(greatest({each}).shard))::INTEGER"


# DuckDB has no function for CRC-32, so the statement folds a table of the 256 byte steps over the bytes.
SQL = f"""
WITH steps AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END) AS c
    FROM range(256) r(b)) x),
d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
c AS (SELECT doc_id, key, octet_length(encode(body))::BIGINT + 1 AS size, xor(4294967295::BIGINT,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(body))), lambda i: ('0x' || substr(hex(encode(body)), 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM d, steps),
s AS (SELECT doc_id, size, text_crc32, {_best(8)} AS shard, {_best(9)} AS grown_shard,
    ('0x' || left(md5(concat_ws('/', doc_id::VARCHAR, text_crc32::VARCHAR)), 8))::BIGINT % greatest(1, (SELECT ceil(count(*) / {SLOT_BLOCK}.0)::BIGINT FROM documents)) AS block FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""


@query("op10_sharding", SQL)
def op10(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), [1.0] * 8)
