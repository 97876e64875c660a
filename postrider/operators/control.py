"""Control-plane tables as relations: heartbeats, commands, jobs, users and grants, codes, rate limits, retention, size estimates."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ago(now: datetime, seconds: float) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECONDS")


def heartbeats(beats: DataFrame, now: datetime, stale_s: int) -> DataFrame:
    """Latest beat of each (kind, account), null accounts counting as one, with staleness; accounts first, the rest last."""
    latest = beats.groupBy("kind", "account_id").agg(F.max("at").alias("last_at"))
    return latest.withColumn("stale", F.col("last_at") < _ago(now, stale_s)).orderBy(F.asc_nulls_last("account_id"), "kind")


def command_states(events: DataFrame) -> DataFrame:
    """Current state of each command from its log of (command_id, state, at)."""
    return events.groupBy("command_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.min("at").alias("requested_at"))


def claimable(events: DataFrame, limit: int) -> DataFrame:
    """The oldest queued commands."""
    return command_states(events).filter("state = 'queued'").orderBy("requested_at", "command_id").limit(limit)


def import_jobs(events: DataFrame) -> DataFrame:
    """Newest first: each job's latest state and counters."""
    order = F.struct("at", "state")
    jobs = events.groupBy("job_id").agg(F.max_by("state", order).alias("state"), F.max("done").alias("done"), F.max("at").alias("updated_at"), F.min("at").alias("created_at"))
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def may_start(jobs: DataFrame) -> bool:
    """Only one job may be active."""
    return jobs.filter("state IN ('pending', 'running')").limit(1).isEmpty()


def reaped(jobs: DataFrame, host: str, live_pids: Iterable[int]) -> DataFrame:
    """Jobs of this host whose process is gone turn failed."""
    dead = (F.col("state") == "running") & (F.col("host") == host) & ~F.col("pid").isin(*(list(live_pids) or [-1]))
    return jobs.withColumn("state", F.when(dead, "failed").otherwise(F.col("state")))


def should_checkpoint(processed: int, at_last: int, seconds: float, every: int, every_s: float) -> bool:
    """First message, every so many, every so many seconds."""
    return processed != at_last and (at_last == 0 or processed - at_last >= every or seconds >= every_s)


def users_with_grants(users: DataFrame, accounts: DataFrame, grants: DataFrame, user_id: int) -> DataFrame:
    """Every account, granted to the user or not: the user is part of the join's condition."""
    own = grants.select(F.col("account_id").alias("_a"), F.col("user_id").alias("_u"))
    joined = accounts.join(own, (F.col("account_id") == F.col("_a")) & (F.col("_u") == user_id), "left")
    return joined.withColumn("granted", F.col("_u").isNotNull()).drop("_a", "_u").orderBy("name")


def active_admins(users: DataFrame) -> int:
    """What the guard of the last administrator counts."""
    return users.filter("is_admin AND enabled").count()


def keys_with_accounts(users: DataFrame, tokens: DataFrame, grants: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each key with the sorted names of its user's accounts; an empty array without any."""
    names = grants.join(accounts, "account_id").groupBy("user_id").agg(F.sort_array(F.collect_set("name")).alias("accounts"))
    return tokens.join(users, "user_id", "left").join(names, "user_id", "left").withColumn("accounts", F.coalesce("accounts", F.array().cast("array<string>")))


def burned(codes: DataFrame, uses: DataFrame, users: DataFrame) -> DataFrame:
    """First use of each code that exists, with its user if there still is one; later uses get nothing."""
    first = uses.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("at", "use_id"))).filter("_n = 1").drop("_n")
    return first.join(codes, "code").join(users, "user_id", "left")


def recent_count(rows: DataFrame, key: str, at: str, now: datetime, seconds: int) -> DataFrame:
    """Rows of each key in a sliding window that ends now."""
    return rows.groupBy(key).agg(F.count_if(F.col(at) > _ago(now, seconds)).alias("n"))


def login_blocked(attempts: DataFrame, user: str, address: str, now: datetime, per_user: int = 5, per_address: int = 20, overall: int = 200, seconds: int = 900) -> bool:
    """Failures of the user since its last success, of the address, and of everyone, each within the window."""
    recent = attempts.filter(F.col("at") > _ago(now, seconds))
    last_ok = recent.filter(F.col("ok") & (F.col("user_name") == user)).agg(F.max("at").alias("t")).first()["t"]
    since = F.lit(True) if last_ok is None else F.col("at") > F.lit(last_ok)
    failed = ~F.col("ok")
    row = recent.agg(F.count_if(failed & (F.col("user_name") == user) & since).alias("u"), F.count_if(failed & (F.col("address") == address)).alias("a"), F.count_if(failed).alias("n")).first()
    return row["u"] >= per_user or row["a"] >= per_address or row["n"] >= overall


def retained(rows: DataFrame, at: str, now: datetime, seconds: int) -> DataFrame:
    """Rows that a retention sweep leaves."""
    return rows.filter(F.col(at) >= _ago(now, seconds))


def unused_clients(clients: DataFrame, tokens: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Clients older than the retention that hold no token."""
    return clients.filter(F.col("created_at") < _ago(now, seconds)).join(tokens.select("client_id"), "client_id", "left_anti")


def syncable(accounts: DataFrame, methods: Iterable[str] = ("password", "oauth")) -> DataFrame:
    return accounts.filter(F.col("auth_method").isin(*methods) & F.col("sync_enabled")).orderBy("account_id")


def earliest_dates(observed: DataFrame, messages: DataFrame) -> DataFrame:
    """Backfill of internal dates: the earliest seen on any folder's copy, for messages without one."""
    low = observed.groupBy("message_id").agg(F.min("internal_date").alias("_d"))
    return messages.join(low, "message_id", "left").withColumn("internal_date", F.coalesce("internal_date", "_d")).drop("_d")


def size_estimate(messages: DataFrame, chunks: DataFrame, rewrite_mb_s: float = 80, index_mb_s: float = 30) -> DataFrame:
    """One row: counts, average widths, and seconds to rewrite and to index at given rates."""
    m = messages.agg(F.count("*").alias("n_messages"), F.coalesce(F.avg(F.octet_length("body_text")), F.lit(0.0)).alias("message_bytes"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg(F.octet_length("text")), F.lit(0.0)).alias("chunk_bytes"))
    both = m.join(c, F.lit(True))  # one row each
    total = F.col("n_messages") * F.col("message_bytes") + F.col("n_chunks") * F.col("chunk_bytes")
    return both.withColumn("rewrite_s", total / (rewrite_mb_s * 1e6)).withColumn("index_s", total / (index_mb_s * 1e6))


def reconcile(running: Iterable[int], wanted: Iterable[int], changed: Iterable[int] = ()) -> tuple[list[int], list[int], list[int]]:
    """Workers to start, to stop, and to start anew."""
    running, wanted = set(running), set(wanted)
    return sorted(wanted - running), sorted(running - wanted), sorted(running & wanted & set(changed))


def next_uid_after(highest_seen: int | None, held: Iterable[int], current: int) -> int:
    """Where a folder's next sync starts: after the highest uid seen, but never past one that is held."""
    after = current if highest_seen is None else max(current, highest_seen + 1)
    return min([after, *held])


def new_uids(uids: Iterable[int], next_uid: int) -> list[int]:
    """Servers answer a range with their last uid even when it is old."""
    return sorted(u for u in uids if u >= next_uid)


def idle_steps(streak: int, made_progress: bool, most: int = 7) -> int:
    """Back-off of an idle worker, in steps."""
    return 0 if made_progress else min(streak + 1, most)
