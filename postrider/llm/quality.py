"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed byte pairs; their log counts, weighted by inverse
document frequency, are projected on the leading singular directions of a bounded
labelled sample.  One more direction carries the share of words that repeat the
word before them, which byte pairs cannot see.  The labelled vectors are
broadcast; every document's cosine with all of them is computed block by block,
and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, blocks, word_hashes, words_of

TERMS = 2048
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
#: Most labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 4096
REPEAT_WEIGHT = 1.0
_ROWS = 256


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS
    sharpness: float = SHARPNESS


def term_counts(texts: pa.Array, rows: int = _ROWS):
    """Yield (first row, counts by text and term, repeat rate by text) for blocks of at most ``rows`` texts."""
    for low in range(0, len(texts), rows):
        for block in blocks(texts.slice(low, rows)):
            n = len(block)
            raw = block.buf[: block.size].astype(np.uint32)
            text = np.repeat(np.arange(n), np.diff(block.offsets))
            same = text[1:] == text[:-1]
            term = ((raw[:-1] << 8 | raw[1:]) * np.uint32(2654435761)) >> np.uint32(32 - TERMS.bit_length() + 1)
            counts = np.bincount(text[1:][same] * TERMS + term[same], minlength=n * TERMS).reshape(n, TERMS)
            starts, lengths, firsts = words_of(block, NON_SPACE)
            h = word_hashes(block, starts, lengths)
            again = np.zeros(len(h) + 1, dtype=np.int64)
            again[1:-1] = h[1:] == h[:-1] if len(h) else 0
            inner = np.flatnonzero(np.diff(firsts) > 0)
            again[firsts[:-1][inner]] = 0
            total = np.concatenate([[0], np.cumsum(again)])
            rate = (total[firsts[1:]] - total[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)
            yield low + block.first, counts, rate


def _weigh(counts: np.ndarray, rate: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.log1p(counts.astype(np.float32)) * idf
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    return np.concatenate([w, (REPEAT_WEIGHT * np.sqrt(rate))[:, None].astype(np.float32)], axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def leading_directions(gram: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """Orthonormal columns that span the leading eigenvectors of a symmetric matrix, by subspace iteration from a seeded start."""
    start = np.random.default_rng(3).standard_normal((len(gram), rank + 16)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram @ basis)[0]
    _, turn = np.linalg.eigh(basis.T @ gram @ basis)
    return np.ascontiguousarray((basis @ turn)[:, -rank:], dtype=np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str, id_col: str, rows: int) -> DataFrame:
    """(label, text) of the ``rows`` usable labelled ids with the smallest hashes, of those that have a text with a byte pair; several labels of an id are averaged, and of several texts the least is taken."""
    ids = labels.filter(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col("text")).filter(F.octet_length("text") > 1)
    ids = ids.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64(F.col("id")), "id").limit(rows)
    return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents (a bound that is documented, and the only sample taken).

    Their term counts come to the driver as sparse rows.  With no labelled row the
    model has no neighbours and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, usable, label_col, id_col, rows)

    def sparse(batches):
        for batch in batches:
            for first, counts, rate in term_counts(batch.column(2)):
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        batch.column(1).slice(first, len(counts)),
                        pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()),
                        pa.array([c[x].astype("<u4").tobytes() for c, x in zip(counts, at)], pa.binary()),
                        pa.array(rate),
                    ],
                    names=["id", "label", "terms", "counts", "rate"],
                )

    found = sample.mapInArrow(sparse, f"id {docs.schema[id_col].dataType.simpleString()}, label double, terms binary, counts binary, rate double").collect()
    found.sort(key=lambda r: r["id"])
    found = [r for r in found if len(r["terms"])]
    if not found:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    counts = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        counts[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<u4")
    labels_of = np.array([r["label"] for r in found])
    idf = (np.log((1 + len(found)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    weighed = _weigh(counts, np.array([r["rate"] for r in found]), idf)
    projection = leading_directions(weighed.T @ weighed, RANK)
    return Model(idf, projection, _unit(weighed @ projection), labels_of, float(labels_of.mean()))


def vote(weighed: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors, of equally near ones those of the smallest ids; the prior where none is similar."""
    k = min(model.neighbours, len(model.labels))
    if k == 0:
        return np.full(len(weighed), model.prior)
    cosine = _unit(weighed @ model.projection) @ model.vectors.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** model.sharpness
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), model.prior).clip(0.0, 1.0)


def score_column(model: Model, text: Column, spark) -> Column:
    """Score in [0, 1] of a text column; null and empty texts get the share of good labels."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model, out = shared.value, np.full(len(texts), 0.5)
        for first, counts, rate in term_counts(texts):
            scores = vote(_weigh(counts, rate, model.idf), model)
            out[first : first + len(counts)] = np.where(counts.any(axis=1), scores, model.prior)
        return pa.array(out)

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add held_out, score and predicted to every row of docs.

    Every row of docs is kept, repeated ids included, and whole texts are read,
    however long; null and empty texts get the share of good labels.  Label rows
    without a document, or with a null label, teach nothing.  Neighbours that are
    equally near are taken in order of their ids, so scores do not depend on how rows
    are partitioned.  Input columns called held_out,
    score or predicted are replaced.
    """
    source = docs.drop("held_out", "score", "predicted")
    texts = source.select(F.col(id_col), F.col(text_col).alias("text"))
    model = fit(texts, labels, ~held_out(F.col(id_col)) & F.col(id_col).isNotNull(), id_col=id_col, rows=sample_rows)
    scored = source.withColumn("score", score_column(model, F.col(text_col), docs.sparkSession))
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
