"""The bound on labelled rows holds for rows, not only for ids; the sample is of labelled documents; scores are those of a plain version."""

import math
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from postrider.llm import quality


def test_one_text_for_each_sampled_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, F.lit(True), "quality", "doc_id", 10).collect()
    assert sorted((r.id, r.label, r.text) for r in got) == [(1, 1.0, "text 0"), (2, 0.0, "other")]


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"good words number {i}" if i % 2 else "zzz zzz zzz") for i in range(60)] + [(61, ""), (62, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2060)], "doc_id long, quality int")
    assert len(quality.labelled_sample(docs, labels, F.lit(True), "quality", "doc_id", 64).collect()) == 60
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels, sample_rows=64).collect()}
    assert all((scores[i] > 0.9) == bool(i % 2) for i in range(60)) and 0 < scores[61] == scores[62] < 1


def plain_score(text, model):
    """The vote of one text, term by term and neighbour by neighbour."""
    raw = (text or "").encode()
    counts = Counter(((raw[i] << 8 | raw[i + 1]) * 2654435761 % 2**32) >> (33 - quality.TERMS.bit_length()) for i in range(len(raw) - 1))
    if not counts:
        return model.prior
    weight = {t: math.log1p(n) * float(model.idf[t]) for t, n in counts.items()}
    size = math.sqrt(sum(w * w for w in weight.values()))
    words = text.replace("\n", " ").split(" ")
    words = [w for w in words if w]
    again = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)
    point = sum((w / size * model.projection[t].astype(float) for t, w in weight.items()), math.sqrt(again) * quality.REPEAT_WEIGHT * model.projection[quality.TERMS].astype(float))
    point = point / np.linalg.norm(point)
    near = sorted(((-float(v.astype(float) @ point), k) for k, v in enumerate(model.vectors)))[: model.neighbours]
    votes = [(max(-c, 0.0) ** model.sharpness, float(model.labels[k])) for c, k in near]
    total = sum(w for w, _ in votes)
    return sum(w * y for w, y in votes) / total if total else model.prior


def test_scores_are_those_of_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = ~quality.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    model = quality.fit(docs, labels, usable)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.classify(docs, labels).collect()}
    for r in docs.limit(60).collect():
        want = plain_score(r.text, model)
        assert abs(got[r.doc_id][0] - want) < 2e-3 and (abs(want - 0.5) < 2e-3 or got[r.doc_id][1] == (want >= 0.5)), r.doc_id
