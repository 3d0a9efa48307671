"""The pipeline against a plain version of each stage on the smallest tables."""

import hashlib
import os

import public_tokenizers
import pytest
from helpers import ODD, contamination, docs, near_groups
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidegauge.llm import bpe, decontamination, exact_dedup, near_dedup, quality
from tidegauge.llm.common import folds, table

SF = "/root/testdata/sf0.001"


def plain(d, labels, items):
    """Rows of the last stage, by plain versions of all but the classifier."""
    model = quality.fit(d, labels, ~folds(3, 1))
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").orderBy("doc_id").collect()]
    rows = [r for r in rows if model is None or model.score([r[1]])[0] >= 0.5]
    last = {t: max(i for i, u in rows if u == t) for _, t in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    groups = near_groups(rows)
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    rows = [r for r in rows if not contamination(r[1], items)[1]]
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = ref.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False))))
    return want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("kept", ["true", "doc_id % 3 = 0", "false"])
def test_run(spark, tmp_path, kept):
    """The whole pipeline, with all labels, with some of them (and some null), and with none."""
    d = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").filter(kept)
    if kept != "true":
        labels = labels.withColumn("quality", F.expr("CASE WHEN doc_id % 12 <> 0 THEN quality END"))
    for name, t in (("documents", d), ("labels", labels), ("benchmark", table(spark, SF, "benchmark"))):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == plain(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"), items)


def test_stages_on_odd_rows(spark):
    df = docs(spark, ODD)
    items = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    for stage in (lambda x: quality.keep_good(x, None), exact_dedup.dedup, near_dedup.dedup, lambda x: decontamination.drop_contaminated(x, items)):
        assert stage(df).columns == df.columns
        assert stage(df.limit(0)).count() == 0
        df = stage(df)
    assert bpe.round_trip(df).count() == df.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "bpe"]
