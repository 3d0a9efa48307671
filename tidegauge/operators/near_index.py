"""A stored index of SimHash fingerprints, and clusters that are kept up to date.

The index is a folder of generations. Each has three Parquet tables that are partitioned by bucket, so that a look-up lists and
reads only the buckets it needs:

* ``pieces`` (choice, v, simhash): the different hashes under each choice of equal pieces (see :func:`simhash.piece_keys`);
* ``entries`` (simhash, key, gen): which keys have a hash, bucketed by the hash;
* ``changes`` (key, gen): what later generations say of keys, bucketed by the key. An entry is dead if a change of its
  key is later; a deletion is a change without an entry, an overwritten key a change with a new one.

An addition or deletion writes its own rows only. :func:`compact` folds all generations into a new base. A generation counts
once its mark is there, which is written last, so a job that dies halfway leaves the index as it was.
Hashes that many keys share are one row among the pieces. Keys that a call names twice keep their largest hash.

Near pairs may grow with the square of the hashes. Who needs their number only asks :meth:`NearIndex.near_counts`, and who needs
clusters :meth:`NearIndex.new_links`; neither makes the pairs.

Clusters are a table (node, root). :func:`link` and :func:`unlink` change the labels of the clusters that an edge touches, and
:func:`without` those of the clusters that lose hashes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators import near_links as L
from tidegauge.operators.joins import small
from tidegauge.operators.simhash import _CC, _PRINTS, BITS, _fast, _signed, free_bits, near_links, piece_keys, plan_pieces
from tidegauge.plans.checkpoints import cut, shared_folder
from tidegauge.plans.skew import components, skew_join
from tidegauge.registry import query
from tidegauge.sources.writers import put

#: Buckets of each table of an index, unless told otherwise.
BUCKETS = 64


def _bucket(n: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


@dataclass
class NearIndex:
    """An index for distances of at most ``k`` in a folder that the driver and all executors share."""

    spark: SparkSession
    path: str
    k: int
    pieces: int
    buckets: int
    kind: str

    @classmethod
    def create(cls, hashes: DataFrame, path: str, key: str, k: int, buckets: int = BUCKETS, pieces: int | None = None) -> NearIndex:
        """A new index over (key, simhash). The number of pieces suits as many hashes as it begins with; another one is as right."""
        found = cls(hashes.sparkSession, path.rstrip("/"), k, pieces or plan_pieces(k, max(1, hashes.count())), buckets, hashes.schema[key].dataType.simpleString())
        put(found.spark, f"{found.path}/index.json", json.dumps({"k": k, "pieces": found.pieces, "buckets": buckets, "kind": found.kind}).encode())
        found._write(0, hashes.groupBy(F.col(key).alias("key")).agg(F.max("simhash").alias("simhash")), None)
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> NearIndex:
        path = path.rstrip("/")
        given = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0])
        return cls(spark, path, given["k"], given["pieces"], given["buckets"], given["kind"])

    def add(self, hashes: DataFrame, key: str) -> None:
        """Entries (key, simhash); a known key gets the new hash."""
        new = cut(hashes.groupBy(F.col(key).alias("key")).agg(F.max("simhash").alias("simhash")))
        self._write(self.generations()[-1] + 1, new, new.select("key"))

    def delete(self, keys: DataFrame, key: str) -> None:
        """Take out keys; unknown ones change nothing."""
        self._write(self.generations()[-1] + 1, None, keys.select(F.col(key).alias("key")).distinct())

    def look_up(self, probes: DataFrame, key: str, k: int | None = None) -> DataFrame:
        """(probe, key, simhash, distance): the entries within distance ``k`` of each probe (key, simhash), itself too if it's indexed."""
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"this index finds distances up to {self.k}")
        asked = cut(piece_keys(probes.select("simhash").distinct(), self.k, self.pieces).withColumn("bucket", _bucket(self.buckets, "choice", "v")))
        near = asked.withColumnRenamed("simhash", "probe_hash").join(self._read("pieces", asked), ["bucket", "choice", "v"])
        distance = F.bit_count(F.col("probe_hash").bitwiseXOR(F.col("simhash")))
        near = cut(near.select("probe_hash", "simhash", distance.alias("distance")).filter(F.col("distance") <= k).distinct())
        held = self._live(near.select("simhash").distinct())
        own = probes.select(F.col(key).alias("probe"), F.col("simhash").alias("probe_hash"))
        return own.join(near, "probe_hash").join(held, "simhash").select("probe", "key", "simhash", "distance")

    def near_counts(self, probes: DataFrame, key: str, k: int | None = None) -> DataFrame:
        """(probe, n, nearest, first_key): how many entries are within distance ``k`` of each probe (key, simhash), the least distance and the smallest key; probes without any are left out.

        For two bits or less no pairs are made. Each hash is laid out with itself and with each bit turned: what lies on a hash are its
        neighbours at distance 1, and two hashes at distance 2 lie together on the two hashes between them. At most 64 different hashes and
        one more lie on any, however many are alike; so the work grows with the hashes. All entries are read, for few probes :meth:`look_up` reads less.
        """
        k = self.k if k is None else k
        if k > 2 or k > self.k:
            return self.look_up(probes, key, k).groupBy("probe").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.min("key").alias("first_key"))
        held = self.live().groupBy("simhash").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.lit(False).alias("asked"))
        asked = probes.select("simhash", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(self.kind).alias("first"), F.lit(True).alias("asked"))
        both = held.unionByName(asked).groupBy("simhash").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("asked").alias("asked"))
        laid = F.array(F.col("simhash"), *(F.col("simhash").bitwiseXOR(F.lit(_signed(1 << b)).cast("bigint")) for b in range(BITS if k else 0)))
        on, own = Window.partitionBy("on"), F.col("bit") == 0
        rows = both.select("*", F.posexplode(laid).alias("bit", "on"))
        met = rows.select("*", F.count("*").over(on).alias("lie"), F.sum(F.when(own, 0).otherwise(F.col("n"))).over(on).alias("around"), F.min("first").over(on).alias("least"))
        met = met.filter(F.col("asked") & (own if k < 2 else own | (F.col("lie") > 1)))
        summed = lambda what, where: F.sum(F.when(where, what).otherwise(0))
        sums = met.groupBy("simhash").agg(summed(F.col("n"), own).alias("n0"), summed(F.col("around"), own).alias("n1"), summed(F.col("around") - F.col("n"), ~own).alias("n2"), F.min("least").alias("first_key"))
        near = sums.select("simhash", F.expr("n0 + n1 + n2 div 2").alias("n"), F.when(F.col("n0") > 0, 0).when(F.col("n1") > 0, 1).otherwise(2).alias("nearest"), "first_key").filter("n > 0")
        return probes.select(F.col(key).alias("probe"), "simhash").join(near, "simhash").select("probe", "n", "nearest", "first_key")

    def new_links(self, hashes: DataFrame, k: int | None = None) -> DataFrame:
        """Links (a, b) between live hashes of this index that join the given ones (simhash), which it holds already, to all that are near: within the buckets they are in, at most one for each row there."""
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"this index finds distances up to {self.k}")
        asked = cut(piece_keys(hashes.select("simhash").distinct(), self.k, self.pieces).select("choice", "v").distinct().withColumn("bucket", _bucket(self.buckets, "choice", "v")))
        there = cut(self._read("pieces", asked).join(asked, ["bucket", "choice", "v"], "left_semi").select("choice", "v", "simhash").distinct())
        alive = self._live(there.select("simhash").distinct()).select("simhash").distinct()
        return L.links(there.join(alive, "simhash", "left_semi"), free_bits(self.k, self.pieces), k, there.count())

    def live(self) -> DataFrame:
        """(key, simhash) of all entries that count."""
        return self._live(None).select("key", "simhash")

    def bucket_sizes(self, warn: int = 200) -> DataFrame:
        """(choice, buckets, largest, crowded): how the live hashes spread over the values of each choice of pieces."""
        n = piece_keys(self.live().select("simhash").distinct(), self.k, self.pieces).groupBy("choice", "v").agg(F.count("*").alias("n"))
        return n.groupBy("choice").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.count_if(F.col("n") > warn).alias("crowded"))

    def compact(self) -> None:
        """All generations as one; older ones are not read any more."""
        last = self.generations()[-1]
        self._write(last + 1, cut(self.live()), None)

    def generations(self) -> list[int]:
        """The base, which is the last generation that changes nothing, and the changes since."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(f"{self.path}/marks")
        names = [s.getPath().getName() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        marks = sorted((int(n.split("-")[0]), n.endswith("-base")) for n in names if n[0].isdigit())
        base = max(g for g, b in marks if b)
        return [g for g, _ in marks if g >= base]

    def _write(self, gen: int, new: DataFrame | None, changed: DataFrame | None) -> None:
        def save(df: DataFrame, name: str, *by: str) -> None:
            rows = df.withColumn("bucket", _bucket(self.buckets, *by))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/gen={gen}")

        if new is not None:
            save(piece_keys(new.select("simhash").distinct(), self.k, self.pieces), "pieces", "choice", "v")
            save(new.select("simhash", "key"), "entries", "simhash")
        if changed is not None:
            save(changed, "changes", "key")
        put(self.spark, f"{self.path}/marks/{gen}-{'base' if changed is None else 'delta'}", b"")

    _FIELDS = {"pieces": "choice long, v long, simhash long", "entries": "simhash long, key {0}", "changes": "key {0}"}

    def _read(self, name: str, asked: DataFrame | None) -> DataFrame:
        """One table over the generations that count, with ``gen``; only the buckets of ``asked``, of which there are few at most."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        paths = [f"{self.path}/{name}/gen={g}" for g in self.generations()]
        paths = [p for p in paths if fs.Path(p).getFileSystem(conf).exists(fs.Path(p))]
        fields = self._FIELDS[name].format(self.kind)
        if not paths:
            return self.spark.createDataFrame([], f"{fields}, bucket int, gen int")
        df = self.spark.read.schema(f"{fields}, gen int, bucket int").option("basePath", f"{self.path}/{name}").parquet(*paths)
        if asked is not None:
            wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
            df = df.filter(F.col("bucket").isin(wanted))
        return df

    def _live(self, hashes: DataFrame | None) -> DataFrame:
        """(simhash, key) of the entries with these hashes (of all, if none are given) that no later change names."""
        if hashes is None:
            found, asked = self._read("entries", None), None
        else:
            hashes = cut(hashes.withColumn("bucket", _bucket(self.buckets, "simhash")))
            found = cut(self._read("entries", hashes).join(hashes, ["bucket", "simhash"], "left_semi"))
            asked = found.select(_bucket(self.buckets, "key").alias("bucket"))
        later = self._read("changes", asked).groupBy("key").agg(F.max("gen").alias("_later"))
        return found.join(later, "key", "left").filter(F.col("_later").isNull() | (F.col("_later") <= F.col("gen"))).select("simhash", "key")


def link(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, root) after edges (a, b) were added: only roots that an edge touches are put together and relabelled.

    A root is the smallest node of its cluster, and stays so. Nodes that are new begin as clusters of their own.
    """
    edges = cut(edges.select("a", "b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    touched = cut(ends.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")))
    n = edges.count()
    of = lambda c: touched.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    between = skew_join(skew_join(edges, of("a"), ["a"], n), of("b"), ["b"], n).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    moved = cut(components(between).filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_to")))
    both = labels.select("node", "root").unionByName(touched.filter("new").select("node", "root"))
    return _relabelled(both, moved)


def unlink(labels: DataFrame, left: DataFrame, gone: DataFrame) -> DataFrame:
    """The labels after edges ``gone`` (a, b) were taken out, given those that are left: the clusters they were in are found anew, inside only."""
    ends = gone.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = cut(labels.join(ends, "node", "left_semi").select("root").distinct())
    inside = cut(labels.join(roots, "root", "left_semi").select("node"))
    again = components(left.select("a", "b").join(inside, F.col("a") == F.col("node"), "left_semi"))
    fresh = inside.join(again, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return labels.join(roots, "root", "left_anti").select("node", "root").unionByName(fresh)


def without(labels: DataFrame, lost: DataFrame, k: int) -> DataFrame:
    """The labels (node, root) of hashes that are clustered at distance ``k`` after the hashes ``lost`` (node) are gone: their clusters are found anew, inside only and from the hashes that are left, so no edges have to be kept."""
    roots = cut(labels.join(lost, "node", "left_semi").select("root").distinct())
    inside = cut(labels.join(roots, "root", "left_semi").select("node").join(lost, "node", "left_anti"))
    again = components(near_links(inside.select(F.col("node").alias("simhash")), k))
    fresh = inside.join(again, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return labels.join(roots, "root", "left_anti").select("node", "root").unionByName(fresh)


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """Labels whose root has moved get the new one; a root may have any share of the nodes, and the moved ones are one row each."""
    return labels.join(small(moved), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def new_pairs(index: NearIndex, hashes: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Edges (a, b) between different hashes, as hashes, that entries (key, simhash) bring to an index that holds them already."""
    near = index.look_up(hashes.select(F.col("simhash").alias("_probe"), "simhash").distinct(), "_probe", k)
    return near.select(F.col("probe").alias("a"), F.col("simhash").alias("b")).filter("a <> b").distinct()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/near-{uuid.uuid4().hex}"


_HELD = "SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 7 ELSE simhash END AS h FROM p WHERE doc_id % 10 NOT IN (3, 4)"


@query("sh_index_look_up", f"WITH {_PRINTS}, held AS ({_HELD}), q AS (SELECT simhash, min(doc_id) AS probe FROM p GROUP BY simhash) SELECT probe, count(*) AS n, min(bit_count(xor(simhash, h)))::INT AS nearest, min(key) AS first_key FROM q JOIN held ON bit_count(xor(simhash, h)) <= 2 GROUP BY probe")
def _(s, d):
    """Additions, overwritten keys, deletions before and after the generations are put together, then every hash is looked up."""
    p = _fast(s, d)
    index = NearIndex.create(p.filter("doc_id % 4 <> 1"), _folder(s), "doc_id", 2, buckets=16)
    index.add(p.filter("doc_id % 4 = 1"), "doc_id")
    index.add(p.filter("doc_id % 10 = 0").select("doc_id", F.lit(7).cast("bigint").alias("simhash")), "doc_id")
    index.delete(p.filter("doc_id % 10 = 3"), "doc_id")
    index.compact()
    index.delete(p.filter("doc_id % 10 = 4"), "doc_id")
    probes = p.groupBy("simhash").agg(F.min("doc_id").alias("probe"))
    return index.near_counts(probes, "probe")


@query("cc_clusters_kept", f"{_CC.replace('FROM f)', 'FROM f WHERE doc_id % 7 <> 3)')} SELECT doc_id, cluster FROM c")
def _(s, d):
    """Clusters of most documents, then those of the others put in, then some taken out."""
    p = _fast(s, d)
    old, new = p.filter("doc_id % 5 <> 0"), p.filter("doc_id % 5 = 0")
    index = NearIndex.create(old, _folder(s), "doc_id", 2, buckets=16)
    labels = cut(components(near_links(old, 2)))
    index.add(new, "doc_id")
    labels = cut(link(labels, index.new_links(new)))
    index.delete(p.filter("doc_id % 7 = 3"), "doc_id")
    held = index.live().select(F.col("simhash").alias("node")).distinct()
    lost = cut(p.select(F.col("simhash").alias("node")).distinct().join(held, "node", "left_anti"))
    labels = without(labels, lost, 2).withColumnRenamed("node", "simhash")
    own = index.live().withColumnRenamed("key", "doc_id").join(labels, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    return own.join(own.groupBy("root").agg(F.min("doc_id").alias("cluster")), "root").select("doc_id", "cluster")
