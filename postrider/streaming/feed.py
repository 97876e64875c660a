"""Streams: a feed that appends arriving rows to a log, polled by the batch change feed, and incremental derivation.

The safety horizon is a filter when the log is read, never a watermark: rows that
arrive late are delivered late, not dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import archive


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_to_log(stream: DataFrame, log: str, checkpoint: str, keys: list[str], available_now: bool = True) -> StreamingQuery:
    """Append rows whose key is new; a batch that is run again after a failure appends nothing twice.

    Each batch is its own folder ``batch=N``, overwritten when repeated, and reads only the others to find known keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if number:
            try:
                old = spark.read.parquet(log).filter(F.col("batch") != number).select(*keys)
                new = new.join(old, keys, "left_anti")
            except Exception as e:  # noqa: BLE001  no earlier batch may have left any file
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        new.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def append_new(stream: DataFrame, log: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append rows whose key the stream has not had before, by keyed state beside the checkpoint: the log itself is never read.

    Of several rows of a key in one batch any one stays.  A batch that is run again replaces its own
    folder ``batch=N``.  Keys of a log that another stream wrote are not known: go on with that stream's checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.dropDuplicates(keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(spark: SparkSession, log: str, since: int | None, now: datetime, **options) -> DataFrame:
    """The change feed over the log; see ``archive.changes``."""
    return archive.changes(spark.read.parquet(log).drop("batch"), since, now, **options)


def _admit(acks: DataFrame, user_id: int, name: str, most: int) -> None:
    """Refuse what is no name, and a new name of a user who has ``most`` of them."""
    if not re.fullmatch(archive.SUBSCRIPTION_NAME.removeprefix(r"\A").removesuffix(r"\z"), name):
        raise ValueError("a subscription's name has 1 to 64 letters, digits, - and _")
    held = acks.filter(F.col("user_id") == user_id).agg(F.count_distinct("name").alias("n"), F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)).alias("known")).first()
    if held.n >= most and not held.known:
        raise ValueError(f"a user has at most {most} subscriptions")


def subscribe(acks: DataFrame, user_id: int, name: str, tip: int, most: int = archive.MOST_SUBSCRIPTIONS) -> DataFrame:
    """Acks with a first cursor at the tip for a subscription that has none, so that its first poll is empty."""
    _admit(acks, user_id, name, most)
    known = acks.filter((F.col("user_id") == user_id) & (F.col("name") == name))
    first = acks.sparkSession.createDataFrame([(user_id, name, tip)], acks.select("user_id", "name", "cursor").schema)
    return acks.select("user_id", "name", "cursor").unionByName(first.join(known.select("user_id", "name"), ["user_id", "name"], "left_anti"))


def acknowledge(acks: DataFrame, user_id: int, name: str, cursor: int, highest: int, most: int = archive.MOST_SUBSCRIPTIONS) -> DataFrame:
    """Append an ack; one beyond the highest id there is, or under a new name of a user with ``most``, is refused."""
    if cursor > highest:
        raise ValueError("the cursor is beyond the newest row")
    _admit(acks, user_id, name, most)
    return acks.unionByName(acks.sparkSession.createDataFrame([(user_id, name, cursor)], acks.schema))


def derive(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a derivation (chunks, embeddings, languages) once over everything that has arrived since the last run."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
