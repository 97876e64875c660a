"""Embedding sweeps: a model loaded once a worker, run over each different text once, never over one that has a vector already."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: What a model is: a function without arguments that loads it, in the worker, and gives texts -> matrix.
Loader = Callable[[], Callable[[list[str]], np.ndarray]]


def content_key(text: Column, model: str) -> Column:
    """What a vector is kept under: the text's digest with the model's name; null texts have none."""
    return F.sha2(F.concat(F.lit(f"{model}\0"), text), 256)


def embedded(text: Column, load: Loader, batch_rows: int = 256) -> Column:
    """The vectors of a text column; ``load`` is called once in each Python worker, and its function once a batch."""

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model([str(t) for t in texts]), dtype=np.float32)

        return predict

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_rows)(text)


def missing(chunks: DataFrame, store: DataFrame | None, model: str, text_col: str = "text") -> DataFrame:
    """(key, text): each different text that the store (key, embedding) has no vector for, once, however many chunks share it."""
    texts = chunks.filter(F.col(text_col).isNotNull()).select(content_key(F.col(text_col), model).alias("key"), F.col(text_col).alias("text"))
    fresh = texts if store is None else texts.join(store.select("key"), "key", "left_anti")
    return fresh.groupBy("key").agg(F.first("text").alias("text"))


def sweep(chunks: DataFrame, store: DataFrame | None, model: str, load: Loader, dim: int, text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """(key, embedding) to append to the store: vectors of the texts that have none yet.

    A vector of another length than ``dim`` stops the sweep: it would make the store useless for search.
    Empty texts are embedded like others; null texts never.
    """
    found = missing(chunks, store, model, text_col).withColumn("embedding", embedded(F.col("text"), load, batch_rows))
    wrong = F.concat(F.lit(f"model {model} gives vectors of another length than {dim}: "), F.size("embedding").cast("string"))
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(wrong).cast("array<float>"))
    return found.select("key", checked.alias("embedding"))


def with_vectors(chunks: DataFrame, store: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Chunks with their vectors from the store; null where there is none (yet)."""
    keyed = chunks.drop("embedding").withColumn("key", content_key(F.col(text_col), model))
    return keyed.join(store.select("key", "embedding"), "key", "left").drop("key")
