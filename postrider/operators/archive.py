"""Aggregates and ledgers of an archive: folders, accounts, queues, rate limits, retries, upserts, the change feed."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names that one user may subscribe under, and what a name is.
MOST_SUBSCRIPTIONS = 32
SUBSCRIPTION_NAME = r"\A[A-Za-z0-9_-]{1,64}\z"


def account_stats(accounts: DataFrame, messages: DataFrame, mailboxes: DataFrame, now: datetime, stale_days: int = 30) -> DataFrame:
    """Message count, last sync and staleness of each account, with or without messages."""
    counts = messages.groupBy("account_id").agg(F.count("*").alias("n_messages"))
    synced = mailboxes.groupBy("account_id").agg(F.max("last_sync_at").alias("last_sync_at"))
    stale = F.coalesce(F.col("last_sync_at") < F.lit(now) - F.expr(f"INTERVAL {stale_days} DAYS"), F.lit(True))
    return accounts.join(counts, "account_id", "left").join(synced, "account_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long"))).withColumn("stale", stale)


def folder_counts(mailboxes: DataFrame, labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("mailbox_id").agg(F.count("*").alias("n_messages"))
    return mailboxes.join(counts, "mailbox_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long")))


def partition_counts(rows: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """One row: eligible, each bucket's count, and misfiled: rows in none or several buckets, or with an unknown condition."""
    together = sum((b.cast("int") for b in buckets.values()), F.lit(0))
    return rows.agg(
        F.count("*").alias("eligible"), *[F.count_if(b).alias(name) for name, b in buckets.items()], F.count_if(~together.eqNullSafe(F.lit(1))).alias("misfiled")
    )


def status_totals(messages: DataFrame, embedded: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row: messages, those with a vector, those with a language, and those too short to detect one; ids of ``embedded`` are unique."""
    rows = messages.join(embedded.select("message_id", F.lit(1).alias("_embedded")), "message_id", "left")
    return rows.agg(
        F.count("*").alias("n_messages"), F.count("_embedded").alias("n_embedded"), F.count("body_lang").alias("n_lang"), F.count_if(F.col("n_chars") < min_chars).alias("n_declined")
    )


def names_by_key(rows: DataFrame, key: str, name: str, chosen: Column) -> DataFrame:
    """(key, names): the distinct names of each key's chosen rows, in order; an empty list where none is chosen."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.when(chosen, F.col(name)))).alias("names"))


def left_joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, residual: Column) -> DataFrame:
    """Every left row with the right rows of its key that also meet the residual condition, or with nulls."""
    return left.join(right.filter(residual), F.col(left_key) == F.col(right_key), "left")


def windowed_counts(rows: DataFrame, at: str, now: datetime, windows: dict[str, tuple[Column, int]]) -> DataFrame:
    """One row of counts, each of its condition within its last so many seconds."""
    recent = lambda seconds: F.col(at) > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECONDS")
    return rows.agg(*[F.count_if(condition & recent(seconds)).alias(name) for name, (condition, seconds) in windows.items()])


def failures_since_success(log: DataFrame, key: str, at: str, ok: Column) -> DataFrame:
    """Failures of each key after its last success; all of them if it never succeeded."""
    # By key and time first, combined before the shuffle; then a key's times fold from the last on.
    seen = log.groupBy(key, at).agg(F.max(ok).alias("good"), F.count_if(~ok).alias("bad"))
    last = F.max(F.when(F.col("good"), F.col(at))).over(W.partitionBy(key))
    counted = seen.withColumn("last_ok", last).groupBy(key)
    return counted.agg(F.sum(F.when(F.col("last_ok").isNull() | (F.col(at) > F.col("last_ok")), F.col("bad")).otherwise(0)).alias("failures"))


def retry_ledger(failures: DataFrame, keys: list[str], at: str, error: str) -> DataFrame:
    """Attempts and the latest error of each key from an append-only log of failures."""
    return failures.groupBy(*keys).agg(F.count("*").alias("retry_count"), F.max_by(error, F.struct(at, error)).alias("last_error"), F.max(at).alias("last_at"))


def pending(rows: DataFrame, done: DataFrame, failures: DataFrame, key: str, cap: int) -> DataFrame:
    """Work still to do: no derived row yet, and fewer failures than the cap."""
    spent = failures.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= cap)
    return without_derived(rows, done, key).join(spent, key, "left_anti")


def without_derived(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that nothing was derived from yet."""
    return rows.join(done.select(key), key, "left_anti")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` to append: the first by ``order`` of each key that ``old`` does not hold."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    match = [old[k].eqNullSafe(first[k]) for k in keys]
    return first.join(old, match, "left_anti")


def upsert_latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The latest row of each key, nulls in the key counting as equal."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*version))).filter("_n = 1").drop("_n")


def dedup_key(internet_id: Column, raw_sha256: Column) -> Column:
    """The Message-Id where there is a real one, else the digest of the bytes."""
    real = F.when(~F.coalesce(internet_id, F.lit("")).rlike(r"^\s*(<\s*>)?\s*$"), F.trim(internet_id))
    return F.coalesce(F.concat(F.lit("id:"), real), F.concat(F.lit("sha:"), raw_sha256))


def rewind_points(tombstones: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Lowest given-up uid of each mailbox that lies below its next uid."""
    low = tombstones.groupBy("mailbox_id").agg(F.min("uid").alias("rewind_to"))
    return low.join(mailboxes.select("mailbox_id", "uidnext"), "mailbox_id").filter("rewind_to < uidnext").select("mailbox_id", "rewind_to")


def changes(rows: DataFrame, since: int | None, now: datetime, horizon_s: int = 5, allowed: Iterable[int] | None = None, limit: int = 200, key: str = "message_id", arrived: str = "date_received") -> DataFrame:
    """Rows after ``since`` in id order, or the newest without it; rows younger than the horizon wait, since ids commit out of order."""
    settled = F.col(arrived) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {horizon_s} SECONDS")
    seen = rows.filter(settled)
    if allowed is not None:
        ids = sorted(set(allowed))
        seen = seen.filter(F.col("account_id").isin(ids) if ids else F.lit(False))
    if since is None:
        return seen.orderBy(F.desc(key)).limit(limit)
    return seen.filter(F.col(key) > since).orderBy(key).limit(limit)


def acknowledged(acks: DataFrame, highest: int) -> DataFrame:
    """Cursor of each subscription: the largest acknowledged id that exists; it never goes back."""
    return acks.filter(F.col("cursor") <= highest).groupBy("user_id", "name").agg(F.max("cursor").alias("cursor"))


def subscriptions(acks: DataFrame, highest: int, at: str, most: int = MOST_SUBSCRIPTIONS) -> DataFrame:
    """(user_id, name, cursor): ``acknowledged`` for the first ``most`` names of each user by their first ack that counts.

    An ack beyond the highest id, or under something that is no name, neither moves nor
    makes a subscription; acks of later names are refused, whatever their cursor.  Names of one moment go by name.
    Each task sends on at most ``most`` names a user.
    """
    counted = (F.col("cursor") <= highest) & F.col("name").rlike(SUBSCRIPTION_NAME)
    named = acks.filter(counted).groupBy("user_id", "name").agg(F.max("cursor").alias("cursor"), F.min(at).alias("_first"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("_first").asc_nulls_last(), "name"))
    return named.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n", "_first")


def held_or_given_up(attempts: DataFrame, now: datetime, seconds: int = 1800) -> DataFrame:
    """Hold ledger of missing bodies: first seen, attempts, and given up once the window is over."""
    ledger = attempts.groupBy("mailbox_id", "uid").agg(F.min("at").alias("first_seen"), F.count("*").alias("attempts"))
    return ledger.withColumn("gave_up", F.col("first_seen") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECONDS"))


def valid_tokens(tokens: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """Tokens that may be used: of enabled users, not expired, issued since the user's sessions were last revoked."""
    at = F.lit(now).cast("timestamp_ntz")
    ok = (F.col("expires_at").isNull() | (F.col("expires_at") > at)) & F.col("enabled") & (F.col("revoked_at").isNull() | (F.col("issued_at") >= F.col("revoked_at")))
    return tokens.join(users, "user_id").filter(ok)


def live_families(uses: DataFrame) -> DataFrame:
    """Token families in which no consumed token was used again."""
    reused = uses.groupBy("family", "token").agg(F.count("*").alias("n")).filter("n > 1").select("family").distinct()
    return uses.select("family").distinct().join(reused, "family", "left_anti")


def config_drift(wanted: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """(name, action, fields): accounts to create, and the stored ones whose fields differ; lists compare as sets."""
    plain = lambda t, c: F.to_json(F.struct(F.sort_array(F.array_distinct(t[c])) if dict(t.dtypes)[c].startswith("array") else t[c]))
    both = wanted.join(stored, wanted["name"] == stored["name"], "left")
    differ = F.filter(F.array(*[F.when(~plain(wanted, c).eqNullSafe(plain(stored, c)), F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    action = F.when(stored["name"].isNull(), "create").when(F.size(differ) > 0, "update").otherwise("keep")
    return both.select(wanted["name"], action.alias("action"), F.when(stored["name"].isNotNull(), differ).otherwise(F.array().cast("array<string>")).alias("fields"))


def folders_to_sync(folders: DataFrame, allow: list[str], deny: list[str], deny_flags: list[str]) -> DataFrame:
    """Folders that can be opened, carry no denied flag, are allowed (an empty list allows all) and not denied."""
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), F.lower)
    out = folders.filter(~F.array_contains(flags, "\\noselect"))
    for flag in deny_flags:
        out = out.filter(~F.array_contains(flags, flag.lower()))
    out = out.filter(F.col("name").isin(*allow)) if allow else out
    return out.filter(~F.col("name").isin(*deny)) if deny else out


def retrieval_quality(hits: DataFrame, relevant: DataFrame, k: int = 20) -> DataFrame:
    """recall@k and MRR@k by language of hits (query_id, doc_id, rank) against (query_id, lang, doc_id)."""
    found = relevant.join(hits.filter(F.col("rank") <= k), ["query_id", "doc_id"], "left")
    by_query = found.groupBy("query_id", "lang").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return by_query.groupBy("lang").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("n_queries"))
