"""JSON of any shape, the content-addressed store, and embedding sweeps."""

import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrider.functions import documents, embedding
from postrider.sources import blobs

ODD = ['[{"filename":"a.pdf","sha256":"1"},{"x":1}]', "{}", "[]", '"t"', '[1,null,{"filename":7},{"filename":null},{"filename":{"a":[1]}}]', "{broken", None, '{"Received":["x","y"],"subject":"s"}', "3", "null", "true"]


def test_documents_of_any_shape(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "message_id int, attachments string")
    text = F.col("attachments")
    got = rows.select("message_id", documents.kind(text).alias("k"), documents.has_attachments(text).alias("has"), documents.names(text).alias("n"), documents.header_values(text, "RECEIVED").alias("r"), documents.header_values(text, "Subject").alias("s")).orderBy("message_id").collect()
    assert [r.k for r in got] == ["array", "object", "array", "string", "array", None, None, "object", "number", "null", "boolean"]
    assert [r.message_id for r in got if r.has] == [0, 4] and got[0].n == ["a.pdf"] and got[4].n == ["7", '{"a":[1]}'] and got[5].n == []
    assert got[7].r == ["x", "y"] and got[7].s == ["s"] and got[0].r == []
    listed = [tuple(r) for r in documents.attachments(rows).orderBy("message_id", "position").collect()]
    assert listed == [(0, 0, "a.pdf", "1", True), (0, 1, None, None, True), (4, 0, None, None, False), (4, 1, None, None, False), (4, 2, "7", None, True), (4, 3, None, None, True), (4, 4, '{"a":[1]}', None, True)]


def test_store_keeps_each_content_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(bytearray(bytes([i % 7]) * (i % 7)),) for i in range(40)] + [(None,)], "content binary").repartition(4)
    counts = []
    threads = [threading.Thread(target=lambda: counts.append(blobs.store(rows, root).count())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert counts == [7, 7] and blobs.store(rows, root).count() == 7
    (tmp_path / "store" / "ab").mkdir(exist_ok=True)
    (tmp_path / "store" / "ab" / "half.part").write_bytes(b"x")
    files = blobs.stored(spark, root)
    assert files.count() == 6 and files.filter(F.sha2("content", 256) != F.col("sha256")).count() == 0
    one = files.first()
    (tmp_path / "store" / blobs.place(one.sha256)).write_bytes(b"other")
    asked = spark.createDataFrame([(one.sha256,), ("0" * 64,), (hashlib.sha256(b"").hexdigest(),)], "sha256 string").unionByName(files.select("sha256").filter(F.col("sha256") != one.sha256).limit(1))
    assert sorted(r.state for r in blobs.with_files(asked, blobs.stored(spark, root)).collect()) == ["corrupt", "missing", "ok", "ok"]


def test_sweep_embeds_each_new_text_once(spark, tmp_path):
    done = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            done.add(len(texts))
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return model

    chunks = spark.createDataFrame([(i, ["aa", "b", "", None, "aab"][i % 5]) for i in range(50)], "chunk_id int, text string").repartition(3)
    embedding.sweep(chunks, None, "m", load, 2).write.parquet(str(tmp_path / "v"))
    store = spark.read.parquet(str(tmp_path / "v"))
    assert done.value == 4 == store.count()
    more = chunks.unionByName(spark.createDataFrame([(60, "new"), (61, "new")], chunks.schema))
    embedding.sweep(more, store, "m", load, 2).write.mode("append").parquet(str(tmp_path / "v"))
    assert done.value == 5
    got = {r.chunk_id: r.embedding for r in embedding.with_vectors(more, spark.read.parquet(str(tmp_path / "v")), "m").collect()}
    assert len(got) == 52 and got[0] == [2.0, 2.0] and got[3] is None and got[61] == [3.0, 0.0]
    assert embedding.missing(more, store, "other").count() == 5
    with pytest.raises(Exception, match="another length than 3"):
        embedding.sweep(chunks, None, "m", load, 3).collect()
