"""Charsets of undeclared bytes: sentences that no model has seen, plain sums, held-out documents and odd bytes."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrider import catalogue
from postrider.functions import charset
from postrider.sources import extract

UNSEEN = [
    (("cp1252", "cp850", "mac_roman"), "Le café était fermé à midi, hélas."),
    (("cp1252", "cp850", "mac_roman"), "Größere Mengen müssen früh bestellt werden."),
    (("cp1252", "cp850", "mac_roman"), "El próximo miércoles habrá una excursión a la montaña."),
    (("cp1250", "iso8859_2"), "Czy możesz mi przysłać książkę, którą czytałeś wczoraj?"),
    (("cp1250", "iso8859_2"), "Zítra přijede můj bratr a půjdeme společně na výlet."),
    (("cp1251", "koi8_r", "iso8859_5", "cp866"), "Завтра утром поезд отправляется в Москву."),
    (("cp1253", "iso8859_7"), "Το βιβλίο είναι πάνω στο τραπέζι."),
    (("cp1254",), "Yarın sabah erken kalkıp işe gideceğim, çünkü çok iş var."),
    (("cp1255",), "הרכבת לתל אביב יוצאת מחר בבוקר"),
    (("cp1256",), "سيغادر القطار إلى المدينة غدا صباحا"),
    (("cp932", "euc_jp"), "明日の朝、電車で大阪へ行きます。"),
    (("gb18030",), "明天早上火车开往北京，请准时到达车站。"),
    (("big5",), "明天早上火車開往臺北，請準時到達車站。"),
    (("cp949",), "내일 아침 기차는 부산으로 출발합니다."),
]
FILES = [(name, text) for names, text in UNSEEN for name in names]


def test_sentences_that_no_model_has_seen(spark):
    files = spark.createDataFrame([(name, text, bytearray(text.encode(name))) for name, text in FILES], "name string, text string, content binary").repartition(3)
    found = files.select("name", "text", charset.decoded(F.col("content")).alias("x")).collect()
    assert len(found) == len(FILES) and all(r.x.text == r.text and r.x.confidence >= charset.CONFIDENCE for r in found)
    assert {r.x.charset for r in found} >= {"koi8_r", "cp866", "cp932", "euc_jp", "big5", "cp949"}


def test_extracted_texts_are_read_in_their_charset():
    for name, text in FILES:
        assert extract.extract_one(text.encode(name), "text/plain", "a.txt") == ("extracted", text)
    assert extract.extract_one("﻿mit Marke".encode(), None, "a.md") == ("extracted", "mit Marke")


@pytest.mark.parametrize("block", [3, 64, 1 << 22])
def test_scores_are_plain_sums_over_the_pairs_of_each_row(monkeypatch, block):
    monkeypatch.setattr(charset, "_BLOCK", block)
    rnd, model = random.Random(5), charset.default_model()
    rows = [bytes(rnd.choice((65, 32, 200, 228, 130, 255)) for _ in range(rnd.choice((0, 0, 1, 2, 7, 90)))) for _ in range(60)]
    got = charset.scores(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), model)
    want = [[sum(int(w[a * 256 + b]) for a, b in zip(r, r[1:]) if a > 127 or b > 127) for w in model.weights] for r in rows]
    assert got.tolist() == want


def test_fitted_weights_equal_a_plain_count(spark):
    rows = [("cp850", "fête à Noël? é"), ("cp850", "été"), ("cp1251", "да"), (None, "é"), ("cp850", None), ("no such charset", "é"), ("cp850", "")]
    model = charset.fit(spark.createDataFrame(rows, "charset string, text string").repartition(4), with_default=False)
    assert model.names == ["cp1251", "cp850"]
    pairs = [(a, b) for t in ("fête à Noël", " é", "été") for a, b in zip(t.encode("cp850"), t.encode("cp850")[1:]) if a > 127 or b > 127]
    for a, b in {*pairs, (130, 65), (65, 66)}:
        first, second = sum(p[0] == a for p in pairs), sum(p[1] == b for p in pairs)
        seen = 0.7 * first / (first + 5)
        p = seen * pairs.count((a, b)) / max(first, 1) + (1 - seen) * (second + 0.05) / (len(pairs) + 0.05 * 256)
        assert model.weights[1, a * 256 + b] == math.floor(1000 * math.log(p))
    assert charset.fit(spark.createDataFrame([], "charset string, text string"), with_default=False).names == []


def test_odd_bytes(spark):
    rows = [(0, None), (1, b""), (2, b"plain"), (3, "﻿mark".encode()), (4, "mark é".encode("utf-16")), (5, b"\xff\xfe\x00\xd8"), (6, os.urandom(4000)), (7, b"\xe9"), (8, "é".encode("cp1252") * 1_500_000)]
    schema = "id int, content binary, x int, charset string"
    files = spark.createDataFrame([(i, None if c is None else bytearray(c), 1, "own") for i, c in rows], schema)
    found = {r.id: r.d for r in files.select("id", charset.decoded(F.col("content")).alias("d")).collect()}
    assert found[0] is None and [found[i].text for i in (1, 2, 3, 4)] == ["", "plain", "mark", "mark é"]
    assert (found[4].charset, found[6].charset, found[7].text) == ("utf-16", "latin-1", "é") and found[6].confidence < charset.CONFIDENCE
    assert len(found[5].text) == 4 and len(found[8].text) == 1_500_000
    none = charset.fit(files.selectExpr("charset", "string(x) AS text").filter("false"), with_default=False)
    assert [r.d.charset for r in files.filter("id IN (2, 7)").orderBy("id").select(charset.decoded(F.col("content"), none, files).alias("d")).collect()] == ["utf-8", "latin-1"]
    assert charset.decoded(F.col("content")) is not None and files.limit(0).select(charset.decoded(F.col("content")).alias("d")).count() == 0


def test_held_out_documents(spark):
    found = catalogue.charset_detection(spark, "/root/testdata/sf0.01").filter("doc_id % 3 = 1 AND (read_as <> 'utf-8' OR NOT same)").collect()
    assert len(found) > 60 and sum(r.same for r in found) >= 0.95 * len(found)
    utf8 = catalogue.charset_detection(spark, "/root/testdata/sf0.01").filter("charset = 'utf-8'")
    assert utf8.filter("NOT same").count() == 0
