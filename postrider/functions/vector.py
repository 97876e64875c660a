"""Vectors: cosine similarity as a native expression, and a hashing embedder to stand in for a model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is null, has another length, or is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine of a column with one given vector, whose norm is computed once."""
    b, norm = literal(vector), math.sqrt(math.fsum(x * x for x in vector))
    if norm == 0:
        return F.lit(None).cast("double")
    own = F.sqrt(dot(a, a))
    return F.when((F.size(a) == len(vector)) & (own > 0), dot(a, b) / (own * norm))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Signed counts of the words' hashes: deterministic, offline, good enough to test retrieval with."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = F.transform(tokens(text), lambda w: F.struct(slot(w).alias("s"), sign(w).alias("v")))
    at = lambda i: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when(p["s"] == i, p["v"]).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)
