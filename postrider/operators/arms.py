"""The four retrieval arms; each gives (message_id, chunk_id, chunk_table, arm_score, rank, arm).

A top-k comes before any rank, so only its rows reach one task.  Ties go by
message, then chunk, both descending for scores as everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rank as R
from ..functions import text as X
from ..functions import vector as V
from ..plans import dsl
from . import cells, positions
from . import filters as P

PREFETCH = 3
FAN_OUT = 10


def top_ranked(scored: DataFrame, limit: int, arm: int) -> DataFrame:
    """Best ``limit`` rows of (message_id, chunk_id, chunk_table, arm_score) with their rank; rows without a score are no hits.

    Those go after the top-k: a filter on the score would be pushed below it and
    compute whatever the score rests on a second time.
    """
    order = [F.desc_nulls_last("arm_score"), F.desc("message_id"), F.desc_nulls_last("chunk_id")]
    top = scored.orderBy(*order).limit(limit).filter("arm_score IS NOT NULL")
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("arm", F.lit(arm))


def tf_score(tree, doc: Column) -> Column:
    return X.term_frequency(doc, X.required_words(tree)).cast("double")


def message_text_arm(messages: DataFrame, query: dsl.Query, limit: int, cover_density: bool = False) -> DataFrame:
    """Arm 1: messages whose text or attachment names match; nothing for a blank text."""
    tree = dsl.expanded_tree(query)
    found = messages.filter(P.may_match(tree, messages))
    if cover_density:
        found = found.filter(P.text_match(tree, messages) if tree is not None else F.lit(False))
        terms = R.alternatives(tree)
        doc = P.weighted(messages)
        # Names are ranked apart, at the subject's weight, and added.
        names = R.weighted_document(F.array_join(F.filter(P.attachment_names(), lambda n: n.isNotNull()), " "), F.lit(""), F.lit(""), F.lit(""))
        score = F.round(R.cover_density_column(doc, terms, R.boosts()) + F.coalesce(R.cover_density_column(names, terms, R.boosts()), F.lit(0.0)), 9)
    else:
        score = F.when(P.text_match(tree, messages), tf_score(tree, P.message_document(messages)))
    scored = found.select("message_id", F.lit(None).cast("long").alias("chunk_id"), F.lit("messages").alias("chunk_table"), score.alias("arm_score"))
    return top_ranked(scored, limit, 1)


def indexed_text_arm(index: positions.Index, messages: DataFrame | None, query: dsl.Query, limit: int) -> DataFrame:
    """Arm 1 by cover density from a positional index, without the messages' texts; ``messages`` restricts it."""
    found = positions.top(index, dsl.expanded_tree(query), limit, messages)
    scored = found.select("message_id", F.lit(None).cast("long").alias("chunk_id"), F.lit("messages").alias("chunk_table"), "arm_score")
    return top_ranked(scored, limit, 1)


def chunk_text_arm(chunks: DataFrame, messages: DataFrame, query: dsl.Query, limit: int, cover_density: bool = False) -> DataFrame:
    """Arm 2: chunks whose words match, of messages that pass the filters; their words have no class, and so the least weight."""
    tree = dsl.expanded_tree(query)
    likely = X.may_match(tree, F.lower("text")) if tree is not None else F.lit(False)
    doc = X.document(F.col("text"))
    score = F.round(R.cover_density_column(R.plain_document(F.col("text")), R.alternatives(tree)), 9) if cover_density else tf_score(tree, doc)
    scored = chunks.filter(likely).select("message_id", "chunk_id", F.lit("message_chunks").alias("chunk_table"), F.when(X.matches(tree, doc), score).alias("arm_score"))
    return top_ranked(scored.join(messages.select("message_id"), "message_id", "left_semi").select(*scored.columns), limit, 2)


def chunk_vector_arm(chunks: DataFrame, messages: DataFrame | None, vector: list[float], limit: int) -> DataFrame:
    """Arm 3: chunks nearest by cosine, exactly; chunks without a vector are skipped."""
    found = chunks.filter("embedding IS NOT NULL")
    if messages is not None:
        found = found.join(messages.select("message_id"), "message_id", "left_semi")
    score = F.round(V.cosine_to(F.col("embedding"), vector), 9)
    scored = found.select("message_id", "chunk_id", F.lit("message_chunks").alias("chunk_table"), score.alias("arm_score")).filter("arm_score IS NOT NULL")
    return top_ranked(scored, limit, 3)


def indexed_vector_arm(index: cells.Cells, messages: DataFrame | None, vector: list[float], limit: int, probes: int | None) -> DataFrame:
    """Arm 3 from an index of cells: only the probed cells' folders are read; None probes give the exact arm."""
    spark = SparkSession.active()
    near = cells.search(spark, index, vector, limit, probes, messages)
    scored = near.select("message_id", "chunk_id", F.lit("message_chunks").alias("chunk_table"), F.col("score").alias("arm_score"))
    return top_ranked(scored, limit, 3)


def attachment_vector_arm(chunks: DataFrame, carriers: DataFrame, vector: list[float], limit: int, prefetch: int = PREFETCH, fan_out: int = FAN_OUT) -> DataFrame:
    """Arm 4: nearest attachment chunks first, without filters; then their carrying messages that pass, at most ``fan_out`` newest a chunk; then the best.

    chunks: (chunk_id, sha256, embedding); carriers: (message_id, sha256, date_sent), filtered already.
    """
    score = F.round(V.cosine_to(F.col("embedding"), vector), 9)
    near = chunks.select("chunk_id", "sha256", score.alias("arm_score")).filter("arm_score IS NOT NULL")
    near = near.orderBy(F.desc("arm_score"), F.desc("chunk_id")).limit(limit * prefetch)
    newest = W.partitionBy("chunk_id").orderBy(F.desc_nulls_last("date_sent"), F.desc("message_id"))
    carried = carriers.join(F.broadcast(near), "sha256").withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= fan_out)
    return top_ranked(carried.select("message_id", "chunk_id", F.lit("attachment_chunks").alias("chunk_table"), "arm_score"), limit, 4)
