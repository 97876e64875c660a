"""Incremental sync: resets, held bodies, and a stream that is stopped and goes on from its checkpoint."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from postrider.streaming import feed, sync

T = datetime(2024, 1, 1)
AT = [T + timedelta(minutes=10 * i) for i in range(40)]


def passes(mailbox, *of):
    """Rows of passes (time, validity, {uid: outcome} or the server's next uid)."""
    out = []
    for at, validity, met in of:
        out += [(mailbox, at, validity, met, None, None)] if isinstance(met, int) else [(mailbox, at, validity, None, u, o) for u, o in met.items()]
    return out


FIRST = passes(1, (AT[0], 5, {1: "ok", 2: "poison", 3: "empty", 4: "ok"}), (AT[1], 5, {3: "empty", 4: "ok", 5: "gone"})) + passes(2, (AT[0], 7, 1), (AT[1], 7, {1: "ok"}))
LATER = passes(1, (AT[2], 5, {3: "empty", 6: "ok"}), (AT[3], 5, {3: "empty", 7: "ok"}), (AT[4], 5, {8: "ok"})) + passes(2, (AT[2], 8, {1: "ok", 2: "empty"}), (AT[3], 8, {2: "ok", 1: "ok"}), (AT[4], 8, 9))


def seen(acts):
    return sorted((r.mailbox_id, r.at, r.uid or 0, r.action, r.attempts or 0, r.uidnext) for r in acts.collect() if r.action != "retry")


def test_replay(spark):
    acts = sync.replay(spark.createDataFrame(FIRST + LATER + [(None, AT[0], 1, None, 1, "ok")], sync.OBSERVATION).repartition(3)).cache()
    by = {(r.mailbox_id, r.at, r.uid): r.action for r in acts.collect()}
    assert by[1, AT[0], 2] == "failed" and by[1, AT[0], 3] == by[1, AT[2], 3] == "hold" and by[1, AT[3], 3] == "gave_up" and by[1, AT[1], 5] == "skip"
    assert by[2, AT[2], None] in ("clear", "progress") and any(r.action == "clear" and r.mailbox_id == 2 for r in acts.collect())
    assert sorted(map(tuple, sync.labels(acts).collect())) == [(1, 1), (1, 4), (1, 6), (1, 7), (1, 8), (2, 1), (2, 2)]
    assert sorted(map(tuple, sync.watermarks(acts).collect())) == [(1, 5, 9), (2, 8, 9)]
    assert list(map(tuple, sync.lost(acts).collect())) == [(1, 3, 4)]
    starts = {r.at: r.uidnext for r in acts.filter("mailbox_id = 1 AND action = 'progress'").collect()}
    assert [starts[a] for a in AT[:5]] == [3, 3, 3, 8, 9]


def test_zero_hold_gives_up_at_once(spark):
    acts = sync.replay(spark.createDataFrame(FIRST, sync.OBSERVATION), hold_s=0)
    assert sorted(map(tuple, sync.watermarks(acts).collect())) == [(1, 5, 6), (2, 7, 2)]


def test_body_and_empty_answer_in_one_pass(spark):
    rows = [r for k in range(4) for r in passes(1, (AT[k], 5, {3: "empty", 4: "ok"}))] + passes(1, (AT[3], 5, {3: "ok"}))
    acts = sync.replay(spark.createDataFrame(rows, sync.OBSERVATION))
    assert list(map(tuple, sync.watermarks(acts).collect())) == [(1, 5, 3)] and sync.lost(acts).isEmpty()
    assert sorted(rows, key=lambda r: sync._in_order(Row(*sync.StructType.fromDDL(sync.OBSERVATION).names)(*r)))[-3:] == [rows[-1], *rows[-3:-1]]


def test_repeated_events_give_the_sqls_rows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    copies = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    copies.withColumns({"event_id": F.col("event_id") + F.col("k") * (n + 1), "user_id": F.col("user_id") + F.col("k") * 1500}).drop("k").write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["sync_replay"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['sync_replay']})").fetchall())


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rnd = random.Random(4)
    more = []
    for box in range(3, 9):
        start, validity = 1, 1
        for at in AT:
            if rnd.random() < 0.1:
                start, validity = 1, validity + 1
            more += passes(box, (at, validity, {u: rnd.choice(["ok", "ok", "empty", "gone", "poison"]) for u in range(max(1, start - 3), start + rnd.randint(0, 4))} or start))
            start += rnd.randint(0, 3)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    every = FIRST + LATER + more
    for low, high in ((0, 2), (2, 11), (11, 40)):
        part = [r for r in every if AT[low] <= r[1] < (AT[high] if high < 40 else datetime.max)]
        spark.createDataFrame(part, sync.OBSERVATION).coalesce(1).write.mode("append").parquet(src)
        stream = feed.arriving(spark, src, StructType.fromDDL(sync.OBSERVATION), 1)
        sync.run(stream, out, ck, retry_s=0).awaitTermination()
    got = spark.read.parquet(out)
    want = sync.replay(spark.createDataFrame(every, sync.OBSERVATION))
    assert seen(got.drop("batch")) == seen(want)
    asked = got.filter("action = 'retry'").select("mailbox_id", "uid").distinct().collect()
    assert asked and {(r.mailbox_id, r.uid) for r in asked} <= {(r.mailbox_id, r.uid) for r in got.filter("action = 'hold'").collect()}


def test_log_knows_its_keys_without_being_read(spark, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    for k in range(3):
        spark.createDataFrame([(i, k) for i in range(k * 30, k * 30 + 40)] + [(5, 9)], "message_id long, v int").coalesce(1).write.mode("append").parquet(src)
        stream = feed.arriving(spark, src, StructType.fromDDL("message_id long, v int"), 1)
        feed.append_new(stream, log, ck, ["message_id"]).awaitTermination()
    rows = spark.read.parquet(log)
    assert rows.count() == 100 and rows.select("message_id").distinct().count() == 100
    feed.append_new(feed.arriving(spark, src, StructType.fromDDL("message_id long, v int"), 1), log, ck, ["message_id"]).awaitTermination()
    assert spark.read.parquet(log).count() == 100
    (tmp_path / "log" / "batch=0").rename(tmp_path / "gone")  # a batch that is read would fail or show
    spark.createDataFrame([(3, 0), (500, 0)], "message_id long, v int").coalesce(1).write.mode("append").parquet(src)
    feed.append_new(feed.arriving(spark, src, StructType.fromDDL("message_id long, v int"), 1), log, ck, ["message_id"]).awaitTermination()
    assert [r.message_id for r in spark.read.parquet(log).filter("message_id IN (3, 500)").collect()] == [500]
