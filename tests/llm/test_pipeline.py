"""The pipeline's stages each take effect, and its whole run gives what they give one by one."""

import corpus_pipeline
from postrider.llm import decontamination


def test_stages_and_run(spark, sf_dir):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == start.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        counts.append(len(rows))
    assert start.count() >= counts[0] >= counts[1] >= counts[2] == counts[3] > 0 and counts[4] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, rows))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    left = decontamination.brute_force([(r.doc_id, r.text) for r in rows[:40]], items)
    assert not any(h for _, h, _ in left.values())


def test_rows_with_nulls_everywhere(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = max((r.text for r in docs.limit(50).collect()), key=len)
    rows = spark.createDataFrame([(None, None, None, None, None), (None, good, None, None, None), (None, good, "en", None, 1), (9001, good, None, "src1", None)], docs.schema)
    left = corpus_pipeline.near_duplicates(spark, rows, sf_dir)
    assert left.count() == 4 and left.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert rows.filter("tokens IS NULL OR epoch IS NULL").count() == 0


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
