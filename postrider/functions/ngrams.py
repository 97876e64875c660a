"""Language by n-grams: naive Bayes over runs of one to four bytes, fitted on texts of known language, scored in whole numbers.

Runs are hashed to a fixed number of buckets for each length, so the model is a table of fixed
size.  Its entries are floored log probabilities, so scores are exact sums and any engine gets the same ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (1, 2, 3, 4)
#: Buckets of each length (a prime).
BUCKETS = 8191
BASE = 257
SCALE = 1000
_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Languages:
    """weights[i, b]: what a run in bucket b says for the language names[i]."""

    names: list[str]
    weights: np.ndarray


def buckets_of(text: np.ndarray) -> list[np.ndarray]:
    """For each length, the buckets of all runs of a text's bytes, A-Z lower-cased, in a range of their own."""
    code, out = np.zeros(len(text), np.int64), []
    low = _LOWER[text].astype(np.int64)
    for k in LENGTHS:
        code = code[: len(low) - k + 1] * BASE + low[k - 1 :] if len(low) >= k else low[:0]
        out.append(code % BUCKETS + (k - 1) * BUCKETS)
    return out


def _texts(column: pa.Array):
    """The bytes of each text of an Arrow column, null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[low:high]


def _counts(text: np.ndarray, size: int) -> np.ndarray:
    """How many runs of a text fall in each bucket; long texts are read in overlapping blocks, each run once."""
    out, reach = np.zeros(size, np.int64), max(LENGTHS) - 1
    for low in range(0, max(len(text), 1), _BLOCK):
        part = buckets_of(text[low : low + _BLOCK + reach])
        for k, found in zip(LENGTHS, part):
            out += np.bincount(found[: _BLOCK if low + _BLOCK < len(text) else len(found)], minlength=size)
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Counts of all runs by language, as each task's sums; texts of unknown language teach nothing.

    Languages are few: each is a row of the table that comes to the driver.
    """
    size = BUCKETS * len(LENGTHS)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if lang not in held:
                    held[lang] = np.zeros(size, np.int64)
                held[lang] += _counts(text, size)
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], names=["lang", "bucket", "n"])

    known = docs.filter(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    found = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.lang for r in found})
    counts = np.zeros((len(names), size), np.int64)
    for r in found:
        counts[names.index(r.lang), r.bucket] = r.n
    totals = counts.reshape(len(names), len(LENGTHS), BUCKETS).sum(axis=2)
    weights = np.zeros_like(counts)
    for i in range(len(names)):
        for b in range(size):
            weights[i, b] = math.floor(SCALE * math.log((int(counts[i, b]) + 1.0) / (int(totals[i, b // BUCKETS]) + float(BUCKETS))))
    return Languages(names, weights)


def detect(docs: DataFrame, model: Languages, text_col: str = "text", least_bytes: int = 1) -> Column:
    """The language of a text column: the highest score, of equal ones the first by name; null for texts under ``least_bytes`` and without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def best(texts: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for text in _texts(texts):
            if len(text) < least_bytes or not model.names:
                out.append(None)
                continue
            counts = _counts(text, model.weights.shape[1])
            used = np.flatnonzero(counts)
            out.append(model.names[int((model.weights[:, used] @ counts[used]).argmax())])
        return pa.array(out, pa.string())

    return best(F.col(text_col))
