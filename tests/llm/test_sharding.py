import hashlib
import math
import zlib
from collections import Counter

from helpers import ODD, docs
from pyspark.sql import functions as F

from tidegauge.llm import sharding


def best(key, weights):
    def score(s, w):
        u = (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -w / math.log(u)

    return max((score(s, w), -s) for s, w in enumerate(weights))[1] * -1


def test_against_plain_hashes(spark):
    rows = ODD + [(i, f"t{i % 3}") for i in range(100, 400)]
    out = sharding.shard(docs(spark, rows), [1.0] * 8).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", best("" if i is None else i, [1.0] * 8), best("" if i is None else i, [1.0] * 9)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in out) == want
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)


def test_weights_and_blocks(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    n = Counter(r.shard for r in sharding.shard(df, [1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and 2.7 < n[1] / n[0] < 3.3
    base = df.select("doc_id", F.lit(0).alias("shard"))
    slots = sharding.slots(base, "shard", F.xxhash64("doc_id"), ["doc_id"], 20_000, block=1_000)
    assert sorted(r.slot for r in slots.collect()) == list(range(20_000))


def test_empty(spark):
    assert sharding.shard(docs(spark, []), [1.0] * 8).count() == 0
