"""Cover density as columns, the positional index and the index of vectors by cell, against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from postrider.functions import rank as R
from postrider.functions import vector as V
from postrider.operators import arms, cells, filters, positions
from postrider.plans import dsl
from postrider.plans.searcher import Archive, Searcher

WORDS = "ant bee cat dog eel fox gnu hen".split()


def messages(spark, n=400, seed=1):
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, k)))
    rows = [(i * 7 - 50, text(4) or None, text(2), None, [text(1)], text(40) or None, [(text(2) + "_" + text(1) + ".pdf", "s")] if i % 3 == 0 else None) for i in range(n)]
    schema = "message_id long, subject string, from_addr string, from_name string, to_addrs array<string>, body_text string, attachments array<struct<filename:string,sha256:string>>"
    return spark.createDataFrame(rows, schema).withColumns({"date_sent": F.lit("2024-01-01").cast("timestamp_ntz"), "internal_date": F.lit(None).cast("timestamp_ntz"), "account_id": F.pmod("message_id", F.lit(3))})


def test_cover_density_is_the_sweep(spark):
    rnd = random.Random(2)
    docs = [([rnd.choice(WORDS) for _ in range(rnd.randint(0, 60))], None) for _ in range(200)] + [([], None), (WORDS * 40, None)]
    docs = [(w, [rnd.randint(0, 3) for _ in w]) for w, _ in docs]
    table = spark.createDataFrame([(i, [{"word": a, "weight": b} for a, b in zip(w, c)]) for i, (w, c) in enumerate(docs)], "i int, doc array<struct<word:string,weight:int>>")
    for sides in ([["ant"]], [["ant", "bee"], ["cat", "cat", "dog"]], [["ant", "fox", "zebra"]], [[]], [["hen", "gnu", "eel", "dog"]]):
        got = {r.i: r.s for r in table.select("i", R.cover_density_column(F.col("doc"), sides).alias("s")).collect()}
        want = {i: sum(R.cover_density(w, c, side) for side in sides if side) for i, (w, c) in enumerate(docs)}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want), sides


def test_positional_index_gives_the_scans_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "FIRST", 2)
    monkeypatch.setattr(positions, "BLOCK", 64)
    m = messages(spark)
    positions.write(m.filter("message_id < 1000"), str(tmp_path / "x"), 8)
    positions.write(m.filter("message_id >= 1000"), str(tmp_path / "x"), 8)
    index = positions.read(spark, str(tmp_path / "x"), 8)
    for text in ("ant", '"ant bee"', '"ant bee cat" OR fox -hen', "-ant", "ant -ant", "pdf", "zebra", "zebra OR eel", '-"ant bee" cat', '"bee bee"', "eel_fox OR pdf"):
        tree = dsl.match_tree(text)
        want = sorted(r[0] for r in m.filter(filters.text_match(tree, m)).select("message_id").collect())
        assert sorted(r[0] for r in positions.matching(index, tree).collect()) == want, text
        q = dsl.parse(text)
        for allowed in [None, m.filter("account_id = 1")][: 2 if "OR" in text else 1] if len(text) > 4 else []:
            plain = arms.message_text_arm(m if allowed is None else allowed, q, 7, cover_density=True).collect()
            found = arms.indexed_text_arm(index, allowed, q, 7).collect()
            assert [(r.message_id, r["rank"], r.arm_score) for r in found] == [(r.message_id, r["rank"], r.arm_score) for r in plain], text
    assert positions.matching(index, None).collect() == []


def test_early_stop_leaves_blocks_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "FIRST", 1)
    rows = [(i, None, None, None, [], "ant " * (50 if i == 700 else 1), None) for i in range(6000)]
    schema = "message_id long, subject string, from_addr string, from_name string, to_addrs array<string>, body_text string, attachments array<struct<filename:string,sha256:string>>"
    positions.write(spark.createDataFrame(rows, schema), str(tmp_path / "x"), 4)
    index = positions.read(spark, str(tmp_path / "x"), 4)
    seen = []
    gathered = positions._gathered
    monkeypatch.setattr(positions, "_gathered", lambda i, t, w, blocks=None: seen.append(None if blocks is None else blocks.count()) or gathered(i, t, w, blocks))
    assert positions.top(index, dsl.match_tree("ant"), 1).first().message_id == 700
    assert seen == [1, 1]  # of 24


def test_search_with_indexes_reads_no_text_and_runs_no_python(spark, tmp_path):
    m = messages(spark)
    m.write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    positions.write(m, str(tmp_path / "x"), 8)
    index = positions.read(spark, str(tmp_path / "x"), 8)
    query = dsl.parse("ant bee OR cat")
    with_index, without = Searcher(Archive(m, positions=index)).fused(query, None, 20), Searcher(Archive(m)).fused(query, None, 20)
    assert sorted(map(tuple, with_index.select("message_id", "rrf_score").collect())) == sorted(map(tuple, without.select("message_id", "rrf_score").collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan(with_index) and "Python" not in plan(with_index) + plan(without) and "Arrow" not in plan(without)


def vectors(spark, n, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, 16)) * 3
    x = centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, 16)) * 0.4
    rows = [(i, i % 90, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, message_id long, embedding array<float>").repartition(4)


def brute(rows, vector, k, keep=lambda r: True):
    score = lambda v: round(float(np.dot(v, vector) / np.linalg.norm(v) / np.linalg.norm(vector)), 9)
    return [i for _, i in sorted(((-score(np.array(r.embedding)), -r.chunk_id) for r in rows if keep(r)))[:k]]


def test_cells_find_neighbours(spark, tmp_path):
    table = vectors(spark, 2000, 40)
    odd = spark.createDataFrame([(9000, 1, None), (9001, 1, [0.0] * 16), (9002, 1, [1.0] * 3), (9003, 1, [float("nan")] * 16)], table.schema)
    index = cells.build(table.unionByName(odd), str(tmp_path / "c"), 40, sample_rows=500)
    assert index.held.sum() == 2000
    rows = table.collect()
    probe = cells.search(spark, index, rows[0].embedding, 50, 3)
    assert "PartitionFilters: [isnotnull(cell" in (plan := probe._jdf.queryExecution().executedPlan().toString()) or "cell#" in plan.split("PartitionFilters")[1][:80]
    for r in rows[::500]:
        near = [-i for i in brute(rows, np.array(r.embedding), 50)]
        exact = cells.search(spark, index, r.embedding, 50)
        assert [x.chunk_id for x in exact.select("chunk_id").collect()] == near
        few = {x.chunk_id for x in cells.search(spark, index, r.embedding, 50, 4).select("chunk_id").collect()}
        assert len(few & set(near)) >= 45
        allowed = spark.createDataFrame([(1,), (2,)], "message_id long")
        near = [-i for i in brute(rows, np.array(r.embedding), 50, lambda x: x.message_id in (1, 2))]
        assert [x.chunk_id for x in cells.search(spark, index, r.embedding, 50, None, allowed).collect()] == near
        assert len(cells.search(spark, index, r.embedding, 30, 1, allowed).collect()) == 30
    assert cells.search(spark, index, [0.0] * 16, 5).collect() == []


def test_many_queries_meet_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_BLOCK", 5)
    monkeypatch.setattr(cells, "FILE_ROWS", 30)
    table = vectors(spark, 1500, 12)
    index = cells.build(table, str(tmp_path / "c"), 12)
    asked = table.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = table.collect()
    truth = {r.chunk_id: [-i for i in brute(rows, np.array(r.embedding), 20)] for r in rows if r.chunk_id % 50 == 0}
    every: dict = {}
    for r in sorted(cells.search_many(spark, index, asked, 20, 12).collect(), key=lambda r: r["rank"]):
        every.setdefault(r.query_id, []).append(r.chunk_id)
    assert every == truth
    found = cells.search_many(spark, index, asked, 20, 3)
    wanted = spark.createDataFrame([(q, i) for q, ids in truth.items() for i in ids], "query_id long, chunk_id long")
    assert cells.recall(found, wanted).agg(F.avg("recall")).first()[0] >= 0.9


def test_indexed_arm_is_the_scans(spark, tmp_path):
    table = vectors(spark, 300, 6)
    index = cells.build(table, str(tmp_path / "c"), 6)
    vector = [float(i % 5 - 2) for i in range(16)]
    scan, own = (sorted((r["rank"], r.chunk_id, r.arm_score) for r in a.collect()) for a in (arms.chunk_vector_arm(table, None, vector, 20), arms.indexed_vector_arm(index, None, vector, 20, None)))
    assert scan == own
    zero = spark.createDataFrame([([1.0],)], "v array<double>")
    assert zero.select(V.cosine_to(F.col("v"), [0.0])).first()[0] is None


def test_empty_index(spark, tmp_path):
    index = cells.build(spark.createDataFrame([], "chunk_id long, message_id long, embedding array<float>"), str(tmp_path / "c"), 4)
    assert cells.search(spark, index, [1.0], 3).collect() == []


def test_index_is_shuffled_once_and_holds_words_by_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "SEGMENT_BYTES", 600)
    m = messages(spark, 90).coalesce(1).withColumn("body_text", F.when(F.col("message_id") == 6, F.repeat(F.lit("ant Über "), 400)).otherwise(F.col("body_text")))
    rows = positions.rows_of(m, 8)
    assert "regexp_extract_all" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    stored = rows.collect()
    assert 5 < max(len(r.messages) for r in stored) < 60
    want = {}
    text = m.select("message_id", F.posexplode(filters.weighted(m)).alias("p", "x")).select("message_id", "x.word", (F.col("p") * 8 + F.col("x.weight")).alias("place"))
    for r in text.collect():
        want.setdefault((r.word, r.message_id), []).append(r.place)
    found = {(r.term, i): ([x for x in p if x % 8 < 4], n, p) for r in stored for i, n, p in zip(r.messages, r.most, r.places)}
    assert len(found) == sum(len(r.messages) for r in stored) and {k: v[0] for k, v in found.items() if v[0]} == want
    assert all(n == sum(x % 8 < 4 or x % 4 == 3 for x in p) for _, n, p in found.values())
    positions.write(m.limit(0), str(tmp_path / "none"), 8)
    positions.write(m, str(tmp_path / "x"), 8)
    index = positions.read(spark, str(tmp_path / "x"), 8)
    assert {(r.term, r.message_id): r.places for r in index.postings.collect()} == {k: v[2] for k, v in found.items()}
