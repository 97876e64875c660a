"""A work queue whose state is folded from its events: claims, attempts, two separate budgets, back-off, and retries.

Events are (sha256, at, kind, error): ``claim`` hands a blob out; ``text`` and ``empty`` finish it; ``poison`` and
``transient`` are failures, each with a budget of its own; ``reset`` opens a blob again.  Nothing is updated in
place: the tables a worker would keep, and who may be claimed now, are aggregates of the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from . import archive

EVENT = "sha256 string, at timestamp_ntz, kind string, error string"
STATE = "sha256 string, done string, retry_count long, transient_count long, last_error string, failed_at timestamp_ntz, transient_at timestamp_ntz, claimed_at timestamp_ntz"
#: Attempts that may fail for the blob's own fault, and failures in a row that are not its fault.
MAX_RETRIES, MAX_TRANSIENT = 3, 5
LEASE_S, BACKOFF_S = 600, 60
_OUTCOMES = ("text", "empty", "poison", "transient")


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def state(log: DataFrame) -> DataFrame:
    """A row for each blob that has events.

    done is text or empty, whichever finished it last, or null; retry_count and transient_count are failures since the last
    reset, the latter also since it was last finished; claimed_at is a claim with no outcome or reset after it.
    Every step combines before it shuffles, so a blob with many events is no large group.
    """
    last = lambda kinds, name: F.max(F.when(F.col("kind").isin(*kinds), F.col("at"))).alias(name)
    marks = log.groupBy("sha256").agg(
        last(["reset"], "reset_at"), last(["text", "empty"], "done_at"), last(["claim"], "claim_at"), last([*_OUTCOMES, "reset"], "settled_at"),
        F.max_by(F.when(F.col("kind").isin("text", "empty"), F.col("kind")), F.when(F.col("kind").isin("text", "empty"), F.struct("at", "kind"))).alias("done"),
    )
    # Failures by blob, kind and time: few rows even of a blob that failed very often at once.
    failures = log.filter("kind IN ('poison', 'transient')").groupBy("sha256", "kind", "at").agg(F.count("*").alias("n"), F.max(F.coalesce("error", F.lit(""))).alias("error"))
    since = failures.join(marks.select("sha256", "reset_at", "done_at"), "sha256")
    poison, transient = F.col("kind") == "poison", F.col("kind") == "transient"
    open_ = F.col("reset_at").isNull() | (F.col("at") > F.col("reset_at"))
    counted = since.filter(open_ & (poison | F.col("done_at").isNull() | (F.col("at") > F.col("done_at")))).groupBy("sha256").agg(
        F.sum(F.when(poison, F.col("n"))).alias("retry_count"), F.sum(F.when(transient, F.col("n"))).alias("transient_count"), F.max_by("error", F.struct("at", "error")).alias("last_error"),
        F.max(F.when(poison, F.col("at"))).alias("failed_at"), F.max(F.when(transient, F.col("at"))).alias("transient_at"),
    )
    claimed = F.when(F.col("settled_at").isNull() | (F.col("claim_at") > F.col("settled_at")), F.col("claim_at"))
    found = marks.join(counted, "sha256", "left").withColumn("claimed_at", claimed)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("sha256", "done", zero("retry_count"), zero("transient_count"), "last_error", "failed_at", "transient_at", "claimed_at")


def tables(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a worker keeps: (sha256, done) of finished blobs, (sha256, retry_count) and (sha256, transient_count) of failing ones."""
    return (
        states.filter("done IS NOT NULL").select("sha256", "done"),
        states.filter("retry_count > 0").select("sha256", "retry_count"),
        states.filter("transient_count > 0").select("sha256", "transient_count"),
    )


def joined(blobs: DataFrame, text: DataFrame, failed: DataFrame, transient: DataFrame) -> DataFrame:
    """Blobs with what is known of them; each of the three tables has a row a blob at most."""
    return blobs.join(text, "sha256", "left").join(failed, "sha256", "left").join(transient, "sha256", "left")


def under_caps(max_retries: int = MAX_RETRIES, max_transient: int = MAX_TRANSIENT) -> Column:
    """Both budgets have room; never null."""
    return (F.coalesce("retry_count", F.lit(0).cast("long")) < max_retries) & (F.coalesce("transient_count", F.lit(0).cast("long")) < max_transient)


def buckets(max_retries: int = MAX_RETRIES, max_transient: int = MAX_TRANSIENT) -> dict[str, Column]:
    """The four states, which are a partition, as conditions over ``joined`` rows."""
    done, under = F.col("done").isNotNull(), under_caps(max_retries, max_transient)
    return {"extracted": F.coalesce(F.col("done") == "text", F.lit(False)), "no_text": done & (F.col("done") != "text"), "gave_up": ~done & ~under, "pending": ~done & under}


def counts(rows: DataFrame, eligible: Column, **caps: int) -> DataFrame:
    """One row: how many eligible blobs there are, in each bucket, and how many are in none or several."""
    return archive.partition_counts(rows.filter(eligible), buckets(**caps))


def claimable(rows: DataFrame, states: DataFrame, now: datetime, limit: int, lease_s: int = LEASE_S, backoff_s: int = BACKOFF_S, **caps: int) -> DataFrame:
    """The ``limit`` oldest pending blobs that no one holds a lease on and whose last passing failure is long enough ago: ``backoff_s``, doubled with each failure in a row."""
    timing = states.select("sha256", "claimed_at", "transient_at")
    held = F.coalesce(F.col("claimed_at") + F.make_dt_interval(secs=F.lit(lease_s)) > _at(now), F.lit(False))
    pause = F.make_dt_interval(secs=(backoff_s * F.pow(F.lit(2), F.coalesce("transient_count", F.lit(1)) - 1)).cast("decimal(18,6)"))
    waits = F.coalesce(F.col("transient_at") + pause > _at(now), F.lit(False))
    free = rows.filter(buckets(**caps)["pending"]).join(timing, "sha256", "left").filter(~held & ~waits)
    return free.orderBy("first_seen_at", "sha256").limit(limit).select(*rows.columns)


def claims(chosen: DataFrame, now: datetime) -> DataFrame:
    """The events that hand out the chosen blobs, to be appended to the log."""
    return chosen.select("sha256", _at(now).alias("at"), F.lit("claim").alias("kind"), F.lit(None).cast("string").alias("error"))


def resets(states: DataFrame, chosen: Column, now: datetime) -> DataFrame:
    """The events that open the chosen failing blobs again: both budgets start anew."""
    failing = states.filter("done IS NULL AND (retry_count > 0 OR transient_count > 0)").filter(chosen)
    return failing.select("sha256", _at(now).alias("at"), F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("error"))


class QueueProcessor(StatefulProcessor):
    """The same fold over events as they arrive, in order of time; a row of a blob's state whenever it has events."""

    def init(self, handle) -> None:
        self.value = handle.getValueState("state", STATE.split(", ", 1)[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in STATE.split(", ")][1:]
        found = self.value.get()
        s = dict(zip(names, found)) if found is not None else dict.fromkeys(names) | {"retry_count": 0, "transient_count": 0}
        for r in sorted(rows, key=lambda r: (r.at, r.kind)):
            if r.kind == "claim":
                s["claimed_at"] = r.at
                continue
            s["claimed_at"] = None
            if r.kind in ("text", "empty"):
                s.update(done=r.kind, transient_count=0, transient_at=None)
            elif r.kind == "reset":
                s.update(retry_count=0, transient_count=0, last_error=None, failed_at=None, transient_at=None)
            elif r.kind == "poison":
                s.update(retry_count=s["retry_count"] + 1, failed_at=r.at, last_error=r.error or "")
            elif r.kind == "transient":
                s.update(transient_count=s["transient_count"] + 1, transient_at=r.at, last_error=r.error or "")
        self.value.update(tuple(s[n] for n in names))
        yield Row(sha256=key[0], **s)

    def close(self) -> None:
        pass


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each blob's state after every batch that has events of it, to folders ``batch=N``; a batch that is run again replaces its own."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    states = stream.groupBy("sha256").transformWithState(QueueProcessor(), StructType.fromDDL(STATE), "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame) -> DataFrame:
    """The last state of each blob of what ``run`` wrote."""
    columns = [f.split()[0] for f in STATE.split(", ")]
    return written.groupBy("sha256").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")

