"""An inverted index as a table: (bucket, term, message_id), stored by term bucket, so that a query reads only its terms' folders.

It gives candidates: every message that can match a tree, and perhaps more.  The
exact match (order, phrases, exclusions) is then made on those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import filters

BUCKETS = 256


def term_bucket(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(messages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row for each message and word, of its text or of its attachments' names."""
    names = F.coalesce(X.names_document(filters.attachment_names()), F.lit(" "))
    words = F.array_distinct(F.array_remove(F.split(F.concat(filters.message_document(messages), names), " "), ""))
    return messages.select("message_id", F.explode(words).alias("term")).withColumn("bucket", term_bucket(F.col("term"), buckets))


def write(messages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append the messages' postings; rows are dealt by bucket and part of the message id, so a frequent word is no single task's or file's."""
    rows = build(messages, buckets).withColumn("_part", F.pmod(F.xxhash64("message_id"), F.lit(8)))
    rows.repartition("bucket", "_part").drop("_part").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(postings: DataFrame, tree, buckets: int = BUCKETS) -> DataFrame | None:
    """Distinct message ids that hold the words a tree requires; None if it can match without any word."""
    if tree is None:
        return None
    kind, value = tree
    if kind == "words":
        wanted = list(value)
    elif kind == "any":
        sides = [candidates(postings, side, buckets) for side in value]
        if any(s is None for s in sides):
            return None
        out = sides[0]
        for s in sides[1:]:
            out = out.unionByName(s)
        return out.distinct()
    else:
        wanted = X.required_words(tree) if kind == "all" else []
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return None
    spark = postings.sparkSession
    ids = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(term_bucket(F.col("term"), buckets)).collect()]
    found = postings.filter(F.col("bucket").isin(*ids) & F.col("term").isin(*wanted))
    if len(wanted) == 1:
        return found.select("message_id").distinct()
    return found.groupBy("message_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("message_id")
