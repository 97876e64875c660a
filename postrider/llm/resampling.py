"""Importance resampling: draw the documents whose features look most like a target's.

Features are runs of one or two words, hashed to buckets.  One pass counts the
buckets of all documents and of the target; an array of one gain a bucket then
scores each document (its mean gain) in a second pass.  Gumbel noise from the id
turns the draw of a given share without replacement into a ranking by an integer
score.  The ranking is exact and sorts nothing as a whole: a histogram of the
scores, summed from the top, gives each score the rank it starts at and shows
at which score the draw ends; only documents at or above that are
numbered, each score by itself.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALNUM_OR_HIGH, Block, blocks, checkpointed, words_of

BUCKETS = 10_000
SCALE = 1000
PERCENT = 25
SEED = 7
LEAST_WORDS = 20
_LONG_WORD = 256


def _crc_table() -> np.ndarray:
    """CRC-32's table by bytes, from its reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def crc_on(block: Block, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of what has the CRC ``before`` and is followed by each word, a byte of all words at a time."""
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -_LONG_WORD) :]  # words longer than that come one by one
    at, left, h = starts[order], lengths[order], before[order] ^ _ALL
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k))
        h[:m] = _CRC[(h[:m] ^ block.buf[at[:m] + k]) & np.uint32(255)] ^ h[:m] >> np.uint32(8)
    out = np.empty(len(starts), np.uint32)
    out[order] = h ^ _ALL
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = zlib.crc32(block.raw[starts[i] : starts[i] + lengths[i]], int(before[i]))
    return out


def features_of(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the single words and of the word pairs, the text of each pair, and the index of each text's first word."""
    starts, lengths, firsts = words_of(block, ALNUM_OR_HIGH)
    one = crc_on(block, starts, lengths, np.zeros(len(starts), np.uint32))
    text = np.repeat(np.arange(len(block)), np.diff(firsts))
    pair = np.flatnonzero(text[1:] == text[:-1])
    joined = one[pair] ^ _ALL  # one more byte, the space
    joined = _CRC[(joined ^ np.uint32(0x20)) & np.uint32(255)] ^ joined >> np.uint32(8) ^ _ALL
    two = crc_on(block, starts[pair + 1], lengths[pair + 1], joined)
    return (one % np.uint32(buckets)).astype(np.int64), (two % np.uint32(buckets)).astype(np.int64), text[pair], firsts


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket: each task sends one row a bucket, and one row a bucket comes to the driver."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                one, two, _, _ = features_of(block, buckets)
                held += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "held"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held")).collect():
        out[r.bucket] = r.held
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled and floored log ratio of each bucket's share in the target to that in the source, both smoothed by one."""
    n = len(source)
    all_source, all_target = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(SCALE * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, text_col: str) -> DataFrame:
    """Add n_words, n_features and weight, the floored mean gain of a document's features (0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        gains = shared.value
        words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for block in blocks(texts, lower=True):
            one, two, text, firsts = features_of(block, len(gains))
            total = np.concatenate([[0], np.cumsum(gains[one])])
            gain = total[firsts[1:]] - total[firsts[:-1]]
            np.add.at(gain, text, gains[two])
            own = slice(block.first, block.first + len(block))
            words[own] = np.diff(firsts)
            features[own] = 2 * words[own] - (words[own] > 0)
            weight[own] = gain // np.maximum(features[own], 1)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(weight)], names=["n_words", "n_features", "weight"])

    found = docs.withColumn("_w", weigh(F.col(text_col)))
    return found.withColumns({k: F.col(f"_w.{k}") for k in ("n_words", "n_features", "weight")}).drop("_w")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled and floored Gumbel noise from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int, id_col: str) -> DataFrame:
    """Add rank: 1, 2, 3... by falling score, of equal scores by id, for the first percent of the eligible rows; null for all others.

    Scores are integers between the least and the largest gain plus noise, some 10^5
    values whatever the input, so their histogram is small.  The rows are written once.
    """
    rows = checkpointed(scored.withColumn("_eligible", F.coalesce(eligible, F.lit(False))))
    held = sorted(((r.score, r.n) for r in rows.filter("_eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in held) // 100
    starts, above = [], 0
    for score, n in held:
        if above >= drawn:
            break
        starts.append((score, above))
        above += n
    starts_df = scored.sparkSession.createDataFrame(starts, "score long, _above long")
    cutoff = starts[-1][0] if starts else None
    in_reach = F.col("_eligible") & (F.col("score") >= cutoff) if starts else F.lit(False)
    rest = rows.filter(~in_reach).withColumn("rank", F.lit(None).cast("long"))
    if not starts:
        return rest.drop("_eligible")
    one_score = W.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]))
    near = rows.filter(in_reach).join(F.broadcast(starts_df), "score").withColumn("rank", F.col("_above") + F.row_number().over(one_score))
    near = near.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rest.columns)
    return near.unionByName(rest).drop("_eligible")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """Add n_words, n_features, weight, score and rank to every row of docs; the rows with a rank are the draw.

    ``target`` has its texts in ``text_col`` too.  A draw takes ``percent`` hundredths
    (rounded down) of the documents with ``least_words`` words and an id, the highest scores
    first and of equal scores the smaller id.  The text goes unless it is asked for; other columns stay, and input
    columns of the added names are replaced.

    Null and empty texts have no words: weight 0, never drawn unless ``least_words``
    is 0.  Texts and words of any length count whole.  A row without an id has null
    score and rank.  Rows that share an id share their noise and are each ranked, ordered by their
    other columns; which of two wholly equal rows comes first is no difference.  An
    empty target makes every gain depend on the source alone; an empty table
    gives an empty result.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    docs = docs.drop(*added)
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    scored = weighed(docs, gains, text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    scored = scored if keep_text else scored.drop(text_col)
    return ranked(scored, (F.col("n_words") >= least_words) & F.col(id_col).isNotNull(), percent, id_col)
