"""Languages by n-grams: held-out accuracy for each language, and a plain version on odd texts."""

import math
from collections import Counter

from pyspark.sql import functions as F

from postrider.functions import ngrams


def test_held_out_accuracy_by_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").filter("length(text) >= 40")
    model = ngrams.fit(docs.filter("doc_id % 3 <> 1"))
    held = docs.filter("doc_id % 3 = 1").withColumn("detected", ngrams.detect(docs, model))
    rates = {r.lang: (r.rate, r.n) for r in held.groupBy("lang").agg(F.avg((F.col("lang") == F.col("detected")).cast("int")).alias("rate"), F.count("*").alias("n")).collect()}
    assert len(rates) >= 4 and sum(n for _, n in rates.values()) > 200 and all(rate > 0.9 for rate, _ in rates.values()), rates


def plain(text):
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    code = lambda run: sum(b * 257 ** (len(run) - 1 - j) for j, b in enumerate(run)) % ngrams.BUCKETS + (len(run) - 1) * ngrams.BUCKETS
    return Counter(code(raw[i : i + k]) for k in ngrams.LENGTHS for i in range(len(raw) - k + 1))


def test_scores_are_those_of_a_plain_version(spark, monkeypatch):
    rows = [(0, "en", "The cat and THE dog"), (1, "de", "Die Katze und der Hünd"), (2, None, "the cat"), (3, "en", None), (4, "de", ""), (5, "fr", "x"), (6, None, "und der " * 500), (7, None, "Ü"), (8, "en", "abc")]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    counts = {}
    for _, lang, text in rows:
        if lang:
            counts[lang] = counts.get(lang, Counter()) + plain(text)
    total = {lang: Counter() for lang in counts}
    for lang, c in counts.items():
        for g, n in c.items():
            total[lang][g // ngrams.BUCKETS] += n
    weight = lambda lang, g: math.floor(1000 * math.log((counts[lang][g] + 1) / (total[lang][g // ngrams.BUCKETS] + ngrams.BUCKETS)))
    best = lambda t: None if not t else max(sorted(counts), key=lambda lang: sum(n * weight(lang, g) for g, n in plain(t).items()))
    for block in (1 << 20, 5):
        monkeypatch.setattr(ngrams, "_BLOCK", block)
        model = ngrams.fit(docs)
        got = {r.doc_id: r.d for r in docs.select("doc_id", ngrams.detect(docs, model).alias("d")).collect()}
        assert got == {i: best(t) for i, _, t in rows}
    assert docs.select(ngrams.detect(docs, ngrams.fit(docs.filter("false"))).alias("d")).distinct().collect() == [(None,)]
