"""The pipeline: each stage on what the one before kept."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline(spark, tmp_path):
    from .test_operators import WORDS, brute_groups, brute_secrets, lowered

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = at["quality_classifier"]
    gone = ids(before) - ids(after)
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in gone for i in good) <= 0.02 * len(good) and sum(labels.get(i) == 0 for i in gone) > 0
    before, after = at["near_dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {i for i, (_, root) in groups.items() if i == root}
    before, after = at["decontamination"]
    items = [" ".join(WORDS.findall(lowered(r.text))) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before.collect() if any(t in " ".join(WORDS.findall(lowered(r.text))) for t in items)}
    assert not ids(after) & dirty and len(ids(before) - ids(after)) <= 1.1 * len(dirty) + 1
    before, after = at["secret_scan"]
    assert ids(before) == ids(after) and all(brute_secrets(r.text)[:3] == (0, 0, 0) for r in after.collect())
    before, after = at["source_mixing"]
    count = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(count) <= ids(before) and max(count.values()) <= 2
    assert corpus_pipeline.run(spark, DIR).count() == after.count()
