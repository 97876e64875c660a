"""A positional index as tables: matches, phrases and ranked searches from postings alone.

Messages are indexed in segments of some ``SEGMENT_BYTES`` of words.  ``postings`` is stored with a row for each segment and word: the
messages that have it, and for each its places (position, field and class of weight in one number) and how many of them count
for ranking; rows lie by bucket of the word, sorted by word.  ``read`` gives a row for each message and word.
``maxima`` has the numbers of places by word and block, a run of message ids.
``messages`` lists what is indexed.

A ranked search stops early: no message scores more than it has places of the
query's words, so the maxima bound every block.  The most promising blocks are scored first, and
after that only blocks whose bound reaches the k-th best score.  The result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rank as R
from ..functions import text as X
from ..plans import dsl
from . import filters as P
from .postings import BUCKETS, term_bucket

#: Message ids of one block.
BLOCK = 256
#: Blocks that are scored first.
FIRST = 64
#: Fields: the message's words, and its attachments' names.
TEXT, NAMES = 0, 1
#: Bytes of words of a segment; and parts at least that a bucket's segments are dealt to, for words that are everywhere.
SEGMENT_BYTES = 16 << 20
PARTS = 4
#: No letter, digit or underscore, so no word.
_END = "\x01"
_ROWS = 20_000


@dataclass
class Index:
    postings: DataFrame
    maxima: DataFrame
    messages: DataFrame
    buckets: int = BUCKETS


def block_of(message_id: Column) -> Column:
    return F.floor(message_id / BLOCK).cast("long")


def _segment(ids: pa.Array, docs: pa.Array, classes: np.ndarray, n_text: int) -> pa.Table:
    """(term, messages, most, places) of documents, each the words of its parts between blanks with ``_END`` between parts; the first ``n_text`` parts are the message's."""
    words = pc.split_pattern(docs, " ")
    doc = np.repeat(np.arange(len(docs)), words.value_lengths().to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    end = code == pc.index(coded.dictionary, _END).as_py()
    word = ~end & (code != pc.index(coded.dictionary, "").as_py())
    part = (np.cumsum(end) - (len(classes) - 1) * doc)[word]
    code, doc = code[word], doc[word]
    n = np.arange(len(code))
    field = np.where(part < n_text, TEXT, NAMES)
    begins = np.diff(doc * 2 + field, prepend=-1) != 0
    place = ((n - np.maximum.accumulate(np.where(begins, n, 0))) * 8 + classes[part] + 4 * field).astype(np.int32)
    key = code << 32 | n
    key.sort()
    code, at = key >> 32, key & 0xFFFFFFFF
    doc, place = doc[at], place[at]
    new_term = np.diff(code, prepend=-1) != 0
    pairs = np.flatnonzero(new_term | (np.diff(doc, prepend=-1) != 0))
    terms = np.flatnonzero(new_term[pairs])
    ranked = np.concatenate([[0], np.cumsum((place % 8 < 4) | (place % 4 == 3))])
    ends = np.append(pairs, len(place))
    cut = lambda starts, total: pa.array(np.append(starts, total), pa.int32())
    of_term = cut(terms, len(pairs))
    places = pa.ListArray.from_arrays(cut(pairs, len(place)), pa.array(place))
    most = np.diff(ranked[ends]).astype(np.int32)
    return pa.table({
        "term": coded.dictionary.take(pa.array(code[pairs[terms]])),
        "messages": pa.ListArray.from_arrays(of_term, ids.take(pa.array(doc[pairs]))),
        "most": pa.ListArray.from_arrays(of_term, pa.array(most)),
        "places": pa.ListArray.from_arrays(of_term, places),
    })


def rows_of(messages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, messages, most, places), a row for each word of a segment of messages, made within the task that has them.

    A place is 8 x position + 4 x field + class, and places are in order of field and position; ``most`` is the number of those that count for ranking.
    Names are indexed as they are, at the subject's class, and again split at what is no
    letter or digit, at the lowest; only the former count for ranking.
    """
    names = F.coalesce(F.left(F.array_join(F.filter(P.attachment_names(), lambda n: n.isNotNull()), " "), F.lit(50_000)), F.lit(""))
    apart = F.regexp_replace(names, r"[^\p{L}\p{N}]+|_", " ")
    text = P.weighted_parts(messages)
    parts = [*text, (names, 3), (apart, 0)]
    classes, n_text = np.array([c for _, c in parts]), len(text)
    doc = F.concat(*[x for i, (p, _) in enumerate(parts) for x in ([F.lit(_END)] if i else []) + [X.document(p)]])
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("messages", T.ArrayType(messages.schema["message_id"].dataType)),
        T.StructField("most", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < len(upto):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SEGMENT_BYTES, side="right")))
                part = batch.slice(low, high - low)
                yield from _segment(part.column(0), part.column(1), classes, n_text).to_batches(_ROWS)
                low = high

    rows = messages.select("message_id", doc.alias("doc")).mapInArrow(run, schema)
    return rows.select(term_bucket(F.col("term"), buckets).alias("bucket"), "term", "messages", "most", "places")


def write(messages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append messages that are not indexed yet, as a batch of their own.

    Rows are shuffled once, by bucket and part of the segments, so a frequent word is several files and tasks, more of them where the session has more partitions.
    """
    spark, batch = messages.sparkSession, uuid.uuid4().hex
    parts = max(PARTS, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
    rows = rows_of(messages, buckets).repartition("bucket", F.pmod(F.xxhash64(F.get("messages", F.lit(0))), F.lit(parts)))
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    messages.select("message_id").write.parquet(f"{path}/messages/batch={batch}")


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    rows = spark.read.parquet(f"{path}/postings")
    each = lambda *of: rows.select("bucket", "term", F.inline(F.arrays_zip(F.col("messages").alias("message_id"), *of)))
    maxima = each("most").select("bucket", "term", block_of(F.col("message_id")).alias("block"), "most")
    return Index(each("places"), maxima, spark.read.parquet(f"{path}/messages"), buckets)


def _words(tree) -> list[str]:
    """All words of a tree, excluded ones too."""
    kind, value = tree
    if kind == "words":
        return list(value)
    return _words(value) if kind == "not" else list(dict.fromkeys(w for x in value for w in _words(x)))


def _of_terms(rows: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    """Rows of some words; only their buckets' folders are read."""
    numbers = rows.sparkSession.range(1).select(*[term_bucket(F.lit(t), index.buckets) for t in terms]).first()
    return rows.filter(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(terms))


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return rows.withColumn("block", block_of(F.col("message_id"))).join(blocks, "block", "left_semi")


def _own(i: int, field: int) -> Column:
    """A gathered word's places in one field, as 4 x position + class; empty where it has none."""
    here = F.filter(F.col(f"_{i}"), lambda x: (x % 8 >= 4) if field == NAMES else (x % 8 < 4))
    return F.coalesce(F.transform(here, lambda x: (F.floor(x / 8) * 4 + x % 4).cast("int")), F.array().cast("array<int>"))


def _gathered(index: Index, tree, terms: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """A row for each message with a column for each word: its places, or null."""
    rows = _of_terms(index.postings, index, terms)
    rows = rows if blocks is None else _in_blocks(rows, blocks)
    found = rows.groupBy("message_id").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"_{i}") for i, t in enumerate(terms)])
    if tree is not None and dsl.holds(tree, " "):  # messages without any of the words match too
        every = index.messages if blocks is None else _in_blocks(index.messages, blocks)
        found = every.select("message_id").join(found, "message_id", "left")
    return found


def _starts(places: Column, k: int) -> Column:
    """Where phrases start whose word number k is at the places."""
    return F.transform(places, lambda x: (x / 4).cast("int") - k)


def _matches(tree, terms: list[str], field: int) -> Column:
    kind, value = tree
    if kind == "not":
        return ~_matches(value, terms, field)
    if kind == "words":
        places = [_own(terms.index(w), field) for w in value]
        if len(places) == 1:
            return F.size(places[0]) > 0
        common = _starts(places[0], 0)
        for k, p in enumerate(places[1:], 1):
            common = F.array_intersect(common, _starts(p, k))
        return F.coalesce(F.size(common) > 0, F.lit(False))
    parts = [_matches(x, terms, field) for x in value]
    found = parts[0]
    for one in parts[1:]:
        found = found & one if kind == "all" else found | one
    return found


def _condition(tree, terms: list[str]) -> Column:
    """What ``filters.text_match`` asks for: the message's words, or its names' where an empty document would not match."""
    found = _matches(tree, terms, TEXT)
    return found if dsl.holds(tree, " ") else found | _matches(tree, terms, NAMES)


def matching(index: Index, tree) -> DataFrame:
    """Ids of the messages that a match tree fits, exactly, phrases and exclusions too; nothing for no tree."""
    if tree is None:
        return index.messages.select("message_id").limit(0)
    terms = _words(tree)
    return _gathered(index, tree, terms).filter(_condition(tree, terms)).select("message_id")


def _density(sides: list[list[str]], terms: list[str], field: int) -> Column:
    """Cover density of a field's gathered places, as of its document."""
    inverse = F.array(*[F.lit(1 / max(w, 1e-9)) for w in R.boosts()])

    def places(t: str, k: int) -> Column:
        own = _own(terms.index(t), field)
        own = own if field == TEXT else F.filter(own, lambda x: x % 4 == 3)
        return F.transform(own, lambda x: F.struct((x / 4).cast("int").alias("position"), F.lit(k).alias("term"), F.get(inverse, x % 4).alias("inverse")))

    total = F.lit(0.0)
    for words in (list(dict.fromkeys(s)) for s in sides if s):
        total = total + R.density(F.sort_array(F.concat(*[places(t, k) for k, t in enumerate(words)])), len(words))
    return total


def top(index: Index, tree, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(message_id, arm_score) of the k messages of the highest cover density among those that match, ties by falling id; ``allowed`` restricts them first."""
    spark = index.postings.sparkSession
    if tree is None:
        return spark.createDataFrame([], "message_id long, arm_score double")
    terms, sides = _words(tree), R.alternatives(tree)
    ranked = list(dict.fromkeys(t for s in sides for t in s))
    score = F.round(_density(sides, terms, TEXT) + _density(sides, terms, NAMES), 9)

    def best(blocks: DataFrame | None) -> DataFrame:
        found = _gathered(index, tree, terms, blocks).filter(_condition(tree, terms))
        found = found if allowed is None else found.join(allowed.select("message_id"), "message_id", "left_semi")
        return found.select("message_id", score.alias("arm_score")).orderBy(F.desc("arm_score"), F.desc("message_id")).limit(k)

    if not ranked or dsl.holds(tree, " "):
        return best(None)
    # A side can match only in blocks that hold all its words.
    held = _of_terms(index.maxima, index, ranked).groupBy("block", "term").agg(F.max("most").alias("most"))
    bounds = held.groupBy("block").agg(F.sum("most").alias("bound"), F.collect_set("term").alias("terms"))
    some = F.lit(False)
    for side in sides:
        some = some | (F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in set(side)]))) == len(set(side)))
    bounds = bounds.filter(some).select("block", "bound")
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    if not first:
        return spark.createDataFrame([], "message_id long, arm_score double")
    scores = [r.arm_score for r in best(spark.createDataFrame([(b,) for b in first], "block long")).collect()]
    reach = bounds if len(scores) < k else bounds.filter(F.col("bound") >= float(scores[-1]))
    return best(reach.select("block"))
