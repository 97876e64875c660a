"""Control-plane operators and language detection."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postrider.functions import language
from postrider.operators import control

NOW = datetime(2024, 1, 2)


def test_jobs(spark):
    events = spark.createDataFrame([(1, "pending", 0, NOW), (1, "running", 5, NOW + timedelta(1)), (2, "pending", 0, NOW + timedelta(2)), (2, "done", 9, NOW + timedelta(3))], "job_id long, state string, done long, at timestamp_ntz")
    jobs = control.import_jobs(events)
    assert [(r.job_id, r.state, r.done) for r in jobs.collect()] == [(2, "done", 9), (1, "running", 5)] and not control.may_start(jobs)
    running = spark.createDataFrame([(1, "running", "h", 10), (2, "running", "h", 11), (3, "running", "x", 10)], "job_id long, state string, host string, pid long")
    assert [r.state for r in control.reaped(running, "h", [11]).orderBy("job_id").collect()] == ["failed", "running", "running"]
    assert [r.state for r in control.reaped(running, "h", []).orderBy("job_id").collect()] == ["failed", "failed", "running"]
    assert [control.should_checkpoint(*a) for a in ((1, 0, 0, 50, 5), (2, 1, 1, 50, 5), (51, 1, 1, 50, 5), (2, 1, 6, 50, 5), (1, 1, 9, 50, 5))] == [True, False, True, True, False]


def test_logins(spark):
    at = lambda m: NOW - timedelta(minutes=m)
    rows = [("ann", "1", False, at(m)) for m in (1, 2, 3, 4, 20)] + [("bob", "2", False, at(m)) for m in (1, 2, 3, 6, 7)] + [("bob", "2", True, at(5))]
    log = spark.createDataFrame(rows, "user_name string, address string, ok boolean, at timestamp_ntz")
    assert not control.login_blocked(log, "ann", "1", NOW) and control.login_blocked(log, "ann", "1", NOW, per_user=4)
    assert not control.login_blocked(log, "bob", "9", NOW, per_user=4) and control.login_blocked(log, "bob", "2", NOW, per_address=5) and control.login_blocked(log, "x", "y", NOW, overall=9)


def test_users_keys_and_clients(spark):
    users = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "user_id long, is_admin boolean, enabled boolean")
    assert control.active_admins(users) == 1
    grants = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "user_id long, account_id long")
    accounts = spark.createDataFrame([(10, "b", "password", True), (11, "a", "oauth", False), (12, "c", "archive", True)], "account_id long, name string, auth_method string, sync_enabled boolean")
    assert [(r.name, r.granted) for r in control.users_with_grants(users, accounts, grants, 2).collect()] == [("a", False), ("b", True), ("c", False)]
    keys = control.keys_with_accounts(users, spark.createDataFrame([(1, 1), (2, 3)], "token_id long, user_id long"), grants, accounts)
    assert {r.token_id: r.accounts for r in keys.collect()} == {1: ["a", "b"], 2: []}
    assert [r.name for r in control.syncable(accounts).collect()] == ["b"]
    clients = spark.createDataFrame([(1, NOW - timedelta(9)), (2, NOW - timedelta(9)), (3, NOW)], "client_id long, created_at timestamp_ntz")
    assert [r.client_id for r in control.unused_clients(clients, spark.createDataFrame([(1,)], "client_id long"), NOW, 86400).collect()] == [2]


def test_sync_points():
    assert control.next_uid_after(None, [], 5) == 5 and control.next_uid_after(9, [], 5) == 10 and control.next_uid_after(9, [7, 8], 5) == 7
    assert control.new_uids([4, 9, 7], 7) == [7, 9]
    assert control.reconcile([1, 2, 3], [2, 3, 4], [3]) == ([4], [1], [3])
    assert [control.idle_steps(*a) for a in ((0, False), (7, False), (3, True))] == [1, 7, 0]


def test_earliest_dates(spark):
    seen = spark.createDataFrame([(1, NOW), (1, NOW - timedelta(1)), (2, NOW)], "message_id long, internal_date timestamp_ntz")
    messages = spark.createDataFrame([(1, None), (2, NOW - timedelta(5)), (3, None)], "message_id long, internal_date timestamp_ntz")
    assert {r.message_id: r.internal_date for r in control.earliest_dates(seen, messages).collect()} == {1: NOW - timedelta(1), 2: NOW - timedelta(5), 3: None}


def test_languages(spark):
    rows = [("the cat is on the mat and it was good",), ("der Hund ist nicht auf dem Sofa und schläft",), ("le chat est dans la maison avec les enfants",), ("short",), (None,), ("https://x.org/the/the/the the",)]
    frame = spark.createDataFrame(rows, "t string")
    assert [r.l for r in frame.select(language.detect(F.col("t")).alias("l")).collect()] == ["en", "de", "fr", None, None, None]
    model = lambda texts: [("xx", 0.9 if "cat" in t else 0.1) for t in texts]
    assert [r.l for r in frame.select(language.detect_with(model, F.col("t")).alias("l")).collect()] == ["xx", None, None, None, None, None]
