"""The work queue: budgets, leases, back-off, resets; a stream that goes on from its checkpoint gives the batch's states."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postrider.operators import queue
from postrider.streaming import feed

T = datetime(2024, 1, 1)


def at(minutes):
    return T + timedelta(minutes=minutes)


def events(spark, *rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], queue.EVENT)


def test_budgets_leases_and_backoff(spark):
    log = events(
        spark,
        *[("poisoned", at(i), "poison", f"e{i}") for i in range(3)], *[("tired", at(i), "transient") for i in range(5)], ("done", at(0), "transient"), ("done", at(1), "text"), ("blank", at(0), "poison"), ("blank", at(2), "empty"),
        *[("again", at(i), "poison") for i in range(3)], ("again", at(9), "reset"), ("held", at(58), "claim"), ("late", at(40), "claim"), ("back", at(50), "claim"), ("back", at(51), "poison"),
        ("waits", at(57), "transient"), ("waits", at(58), "transient"), ("waits", at(58.5), "transient"), ("ready", at(50), "transient"),
    )
    names = "poisoned tired done blank again held late back waits ready fresh".split()
    blobs = spark.createDataFrame([(n, at(-len(names) + i)) for i, n in enumerate(names)], "sha256 string, first_seen_at timestamp_ntz")
    states = queue.state(log).cache()
    by = {r.sha256: r for r in states.collect()}
    assert (by["poisoned"].retry_count, by["poisoned"].last_error, by["tired"].transient_count, by["done"].done, by["done"].transient_count, by["again"].retry_count) == (3, "e2", 5, "text", 0, 0)
    rows = queue.joined(blobs, *queue.tables(states))
    assert queue.counts(rows, F.lit(True)).first().asDict() == {"eligible": 11, "extracted": 1, "no_text": 1, "gave_up": 2, "pending": 7, "misfiled": 0}
    free = lambda minutes, n=20: [r.sha256 for r in queue.claimable(rows, states, at(minutes), n).collect()]
    assert free(60) == ["again", "late", "back", "ready", "fresh"] and free(60, 2) == ["again", "late"]
    assert free(62.6) == ["again", "late", "back", "waits", "ready", "fresh"] and "held" in free(69)
    taken = queue.claims(queue.claimable(rows, states, at(60), 2), at(60))
    after = queue.state(log.unionByName(taken))
    assert [r.sha256 for r in queue.claimable(queue.joined(blobs, *queue.tables(after)), after, at(61), 2).collect()] == ["back", "ready"]
    opened = queue.state(log.unionByName(queue.resets(states, F.lit(True), at(60))))
    assert queue.counts(queue.joined(blobs, *queue.tables(opened)), F.lit(True)).first().gave_up == 0


def test_stream_is_the_batch(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"b{rnd.randint(0, 20)}", at(i), rnd.choice(["claim", "poison", "transient", "transient", "reset", "text", "empty"]), rnd.choice([None, "x", "y"])) for i in range(300)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for low in range(0, 300, 100):
        spark.createDataFrame(rows[low : low + 100], queue.EVENT).coalesce(1).write.mode("append").parquet(src)
        queue.run(feed.arriving(spark, src, StructType.fromDDL(queue.EVENT), 1), out, ck).awaitTermination(60)
    plain = lambda df: sorted((r.sha256, r.done, r.retry_count, r.transient_count, r.failed_at if r.retry_count else None, r.transient_at if r.transient_count else None, r.claimed_at) for r in df.collect())
    assert plain(queue.latest(spark.read.parquet(out))) == plain(queue.state(spark.createDataFrame(rows, queue.EVENT)))
