"""Importance resampling, token counts and vector codes against plain versions, with nulls, repeats, ties and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postrider.llm import resampling, token_counts, vector_codes
from postrider.llm.common import blocks

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(seed: int, n: int) -> list[str | None]:
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "été", "ñandú", "x1", "日本", "don't", "<|endoftext|>", "12 3", "a-b", "É", "é", " ́", " ", " ", "ſ", "İ", "ΣΑΣ", "q" * 300, "\U0001f600"]
    out = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", "\t", "", ".", " , "]) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return [None, "", " ", "\n \t", *out, out[0], "word " * 30_000, "z" * 20_000]


def plain_features(text: str | None) -> tuple[int, list[bytes]]:
    w = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:])]


def plain_resample(rows, target, percent, least):
    source, wanted = (Counter(zlib.crc32(f) % 10_000 for t in ts for f in plain_features(t)[1]) for ts in ([t for _, t in rows], target))
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (source.total() + 10_000) / ((source[b] + 1) * (wanted.total() + 10_000))))
    out = {}
    for i, t in rows:
        n, f = plain_features(t)
        weight = sum(gain(zlib.crc32(x) % 10_000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [n, len(f), weight, score, None]
    order = sorted((i for i, v in out.items() if v[0] >= least and i is not None), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(order[: percent * len(order) // 100]):
        out[i][4] = k + 1
    return out


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (100, 1), (0, 0), (60, 0)])
def test_resample_is_as_counted_by_hand(spark, percent, least):
    rows = [*enumerate(texts(5, 60)), (None, "no id " * 30)]
    target = ["alpha beta gamma", None, "", "Beta x1 été " * 9]
    docs = spark.createDataFrame([(i, t, "w", 5) for i, t in rows], "doc_id long, text string, weight string, other int").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, least_words=least)
    assert got.columns == ["doc_id", "other", "n_words", "n_features", "weight", "score", "rank"]
    assert {r.doc_id: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == plain_resample(rows, target, percent, least)


def test_equal_scores_go_by_id_and_repeats_each_take_a_rank(spark):
    docs = spark.createDataFrame([(i // 2, "same words here") for i in range(40)], "doc_id long, text string")
    got = resampling.resample(docs, docs.limit(0), 50, least_words=1, keep_text=True).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and all(r.text for r in got)
    scored = spark.createDataFrame([(i, 3) for i in range(30)] + [(99, 4)], "doc_id long, score long").repartition(4)
    ranks = {r.doc_id: r["rank"] for r in resampling.ranked(scored, resampling.F.lit(True), 50, "doc_id").collect()}
    assert ranks == {99: 1} | {i: i + 2 if i < 14 else None for i in range(30)}


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_whole_texts(spark, name):
    tokens = token_counts._tokens(name)
    assert tokens.cuts == {"word": "drops", "byte": "leads", "piec": "marks"}[name[:4]]
    every = texts(8, 120) + ["a b", "1 a  b", "a b ", " a b c", "á b", "x <|endoftext|> y", "<s> a </s>", "▁a ▁b", "a ▁b"]
    want = [len(x) for x in tokens.encode([t or "" for t in every])]
    assert token_counts.count_tokens(pa.array(every), tokens).tolist() == want
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(every)], "doc_id long, text string, n_tokens int").repartition(3)
    got = token_counts.add_token_counts(docs, tokenizer=name, limit=40).collect()
    assert sorted((len((r.text or "").encode()), r.n_tokens, r.n_tokens > 40) for r in got) == sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(want)


def test_pieces_join_to_the_texts():
    every = pa.array(["", "a b c", "", "x  y z", " ", "a b", "b"])
    (block,) = blocks(every)
    for cuts in ("leads", "whole"):
        starts, lengths, firsts = token_counts.pieces_of(block, cuts)
        own = [b"".join(block.raw[s : s + n] for s, n in zip(starts[a:z], lengths[a:z])).decode() for a, z in zip(firsts, firsts[1:])]
        assert own == every.to_pylist()
    starts, lengths, _ = token_counts.pieces_of(block, "marks")
    assert [block.raw[s : s + n] for s, n in zip(starts, lengths)] == [b"", b"a", b"b", b"c", b"", b"x  y", b"z", b" ", b"a", b"b", b"b"]


def test_remembered_counts_do_not_matter(monkeypatch):
    tokens = token_counts.Tokens(__import__("public_tokenizers").path(token_counts.TOKENIZER))
    every = pa.array(texts(3, 30))
    want = token_counts.count_tokens(every, tokens).tolist()
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(token_counts, "CALL_BYTES", 7)
    assert token_counts.count_tokens(every, tokens).tolist() == want == token_counts.count_tokens(every, tokens).tolist()


def test_unknown_steps_are_not_cut():
    assert token_counts._cuts_of({"normalizer": {"type": "Prepend", "prepend": "x"}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}) == "whole"
    assert token_counts._cuts_of({"pre_tokenizer": {"type": "Whitespace"}, "added_tokens": []}) == "whole"


def dense(x: np.ndarray, entries: np.ndarray):
    d = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(4)
    for n, k, m, reach in ((700, 256, 16, 300), (50, 1, 1, 5), (300, 7, 5, 2), (40, 256, 16, 2**26), (1, 3, 2, 0), (600, 40, 6, 1)):
        x, entries = rng.integers(-reach, reach + 1, (n, m)), rng.integers(-reach, reach + 1, (k, m))
        which, least = vector_codes.nearest(x, entries)
        want_which, want_least = dense(x, entries)
        assert which.tolist() == want_which.tolist() and least.tolist() == want_least.tolist()


def plain_codes(rows):
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in good], dtype=object).reshape(len(good), 4, 2)
    books = x[:256].transpose(1, 0, 2).copy()
    for _ in range(4):
        for p in range(4):
            near, _ = dense(x[:, p], books[p])
            for e in set(near):
                own = x[near == e, p]
                books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    found = [dense(x[:, p], books[p]) for p in range(4)]
    error = sum(e for _, e in found)
    by_label = Counter()
    for (_, _, label), e in zip(good, error):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{w[k]:02x}" for w, _ in found), error[k], by_label[label], sha) for k, (i, _, label) in enumerate(good))


@pytest.mark.parametrize("n", [600, 90])
def test_codes_are_as_computed_by_hand(spark, n, monkeypatch):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.25, 0.1, 0.5, rng.gauss(0, 0.3)]) for _ in range(8)], rng.choice([0, 0, 0, 1, None, i])) for i in range(n)]
    rows += [(5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [0.1] * 7 + [float("nan")], 1), (5003, [float("inf")] + [0.1] * 7, 1), (5004, [], 1), (5005, [0.1] * 12, 1), (-1, [0.5] * 7, 1)]
    rows += [(None, [0.3] * 8, 7), (3, [0.2] * 8, 7), rows[4], rows[4]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, error string").repartition(4)
    want = plain_codes(rows)
    for most in (500_000, 1):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        got = vector_codes.compress(table)
        assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == want


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none).collect() == []


def test_codes_can_be_read_back(spark):
    rows = [(i, [i / 8, -i / 8, 0.0, 1.0], 0) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept, dim = vector_codes.kept_vectors(table, "vec_id", "embedding", 4)
    book = vector_codes.train(kept, dim)
    assert all(vector_codes.decode(book, r.code) == r.embedding for r in vector_codes.encode(kept, dim, book).collect())
