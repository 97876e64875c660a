"""Reciprocal rank fusion, the pool's cut and order, hydration, and reranking of the final pool."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import filters as P

K = 60


def fuse(arms: list[DataFrame], k: int = K) -> DataFrame:
    """(message_id, best_chunk_id, best_chunk_table, rrf_score, contributing_arms): every hit of every arm adds 1 / (k + rank).

    The best chunk has the largest single contribution; of equals the first seen
    (lower arm, then lower rank) wins, by its first appearance.
    """
    hits = arms[0]
    for arm in arms[1:]:
        hits = hits.unionByName(arm)
    hits = hits.withColumn("gain", F.lit(1.0) / (k + F.col("rank")))
    chunks = hits.groupBy("message_id", "chunk_id", "chunk_table").agg(
        F.max("gain").alias("gain"), F.min(F.struct("arm", "rank")).alias("seen"), F.sum("gain").alias("total"), F.collect_set("arm").alias("arms")
    )
    return (
        chunks.groupBy("message_id")
        .agg(
            F.round(F.sum("total"), 12).alias("rrf_score"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("arms")))).alias("contributing_arms"),
            F.min(F.when(F.col("chunk_id").isNotNull(), F.struct((-F.col("gain")).alias("g"), F.col("seen"), F.col("chunk_id"), F.col("chunk_table")))).alias("best"),
        )
        .select("message_id", F.col("best.chunk_id").alias("best_chunk_id"), F.col("best.chunk_table").alias("best_chunk_table"), "rrf_score", "contributing_arms")
    )


def cut_pool(fused: DataFrame, dates: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` by score, then newest with undated last, then highest id; dates: (message_id, effective_date)."""
    dated = fused.join(dates.select("message_id", "effective_date"), "message_id", "left")
    return dated.orderBy(F.desc("rrf_score"), F.desc_nulls_last("effective_date"), F.desc("message_id")).limit(limit)


def without_served(fused: DataFrame, served: DataFrame) -> DataFrame:
    return fused.join(served.select("message_id"), "message_id", "left_anti")


def hydrate(pool: DataFrame, messages: DataFrame, chunks: DataFrame | None, terms: list[str], width: int = 200, attachment_chunks: DataFrame | None = None) -> DataFrame:
    """Message columns, the best chunk's text (or the body) as a snippet; messages that are gone drop out.

    Chunks of messages and of attachments are numbered apart, so a best chunk is its table and its number.
    """
    out = pool.join(messages.withColumn("_body", P.body(messages)).select("message_id", "subject", "from_addr", "_body"), "message_id")
    named = [(t, rows) for t, rows in (("message_chunks", chunks), ("attachment_chunks", attachment_chunks)) if rows is not None and "text" in rows.columns]
    texts = None
    for table, rows in named:
        one = rows.select(F.lit(table).alias("best_chunk_table"), F.col("chunk_id").alias("best_chunk_id"), F.col("text").alias("chunk_text"))
        texts = one if texts is None else texts.unionByName(one)
    out = out.withColumn("chunk_text", F.lit(None).cast("string")) if texts is None else out.join(texts, ["best_chunk_table", "best_chunk_id"], "left")
    source = F.coalesce(F.col("chunk_text"), F.col("_body"), F.lit(""))
    kind = F.when((F.col("best_chunk_table") == "attachment_chunks") & F.col("chunk_text").isNotNull(), "attachment").otherwise("body")
    return out.withColumn("snippet", X.snippet(source, terms, width)).withColumn("snippet_source", kind).drop("chunk_text", "_body")


def paged(pool: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a pool, ranks starting at 1 on each page; only the rows up to its end are ranked."""
    low = (page - 1) * size
    place = F.row_number().over(W.orderBy(*order))
    return pool.orderBy(*order).limit(low + size).withColumn("place", place).filter(F.col("place") > low).withColumn("rank", F.col("place") - low).drop("place")


def finite_scores(scores: list[float], fallback: list[float]) -> list[float]:
    """Non-finite scores sink just below the least finite one; without a finite one the fallback holds."""
    finite = [s for s in scores if math.isfinite(s)]
    if not finite:
        return list(fallback)
    floor = math.nextafter(min(finite), -math.inf)
    return [s if math.isfinite(s) else floor for s in scores]


def rerank(rows: list[dict], query: str, score: Callable[[str, list[str]], list[float]] | None, chars: int = 1500) -> list[dict]:
    """Reorder a collected pool (at most some hundred rows) by a scorer; if it fails, or there is none, fused scores stay."""
    fallback = [r["rrf_score"] for r in rows]
    scores = fallback
    if score is not None and rows:
        try:
            given = [float(s) for s in score(query, [(r.get("text") or "")[:chars] for r in rows])]
            scores = finite_scores(given, fallback) if len(given) == len(rows) else fallback
        except Exception:  # noqa: BLE001  a broken scorer degrades to the fused order, whatever it raises
            scores = fallback
    key = lambda p: (p[0], p[1].get("effective_date") is not None, str(p[1].get("effective_date") or ""), p[1]["message_id"])
    return [dict(r, score=s) for s, r in sorted(zip(scores, rows), key=key, reverse=True)]
