"""Quality rules by host: rule failures are aggregated by host, shrunk, and judged there.

Everything is DataFrame functions.  A host's failure rate is shrunk towards the
corpus by a beta prior whose strength is fitted to the spread of the hosts' rates
(method of moments).  A host whose shrunk rate is over ``reject_rate`` is rejected
whole; in a host over ``watch_rate`` every document that fails any rule goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
REJECT_RATE = 0.5
WATCH_RATE = 0.25
#: Most hosts whose verdicts are broadcast; more are joined by shuffle with salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _repeated(w: Column) -> Column:
    """Words covered by windows that occur at least twice in the array of words."""

    def covered(pairs: Column) -> Column:
        beside = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: beside(x, i - 1) | beside(x, i + 1))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def of_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, covered))

    def of_hashes(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)


def features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    long = lambda c, name: c.cast("long").alias(name)
    by_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeat")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda s: F.struct(
            long(s["w"]["n"], "n_words"), long(F.length(F.translate(text, SPACES, "")), "word_chars"),
            long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            long(s["l"]["n"], "n_lines"), long(s["l"]["dup"], "n_dup_lines"), long(s["w"]["repeat"], "n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def any_failed() -> Column:
    """Base rules, or symbols over a tenth of the characters, or over three tenths repeated lines."""
    return F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """Add rate, the posterior mean of each host's failure rate, to (host, n, failed)."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).first()
    mean = (total["failed"] / total["n"]) if total["n"] else 0.0
    spread = hosts.agg((F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, 2)) / F.sum("n")).alias("v")).first()["v"] or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", reject_rate: float = REJECT_RATE, watch_rate: float = WATCH_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(id, host, features, base_failed, any_failed, host_rate, host_verdict, kept): one row per row of docs.

    The text is read once; only numbers are kept for the second step.  A null host
    is the host ''.  Null and empty texts have no words and fail; an empty table
    gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), features(F.col(text_col)).alias("f"))
    counted = source.select("id", "host", "f.*").withColumn("base_failed", base_failed()).withColumn("any_failed", any_failed())
    counted = checkpointed(counted)
    hosts = checkpointed(counted.groupBy("host").agg(F.count("*").alias("n"), F.count_if("any_failed").alias("failed")))
    rates = shrunk_rates(hosts).select("host", F.col("rate").alias("host_rate"))
    if hosts.count() <= broadcast_hosts:
        joined = counted.join(F.broadcast(rates), "host")
    else:
        salted = counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, ["host", "salt"]).drop("salt")
    verdict = F.when(F.col("host_rate") > reject_rate, "reject").when(F.col("host_rate") > watch_rate, "watch").otherwise("pass")
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & ~((F.col("host_verdict") == "watch") & F.col("any_failed"))
    return joined.withColumn("host_verdict", verdict).withColumn("kept", kept).withColumnRenamed("id", id_col)
